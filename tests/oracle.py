"""Runs a query and its SQL on the same tables and lists the rows in which they differ."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "None" if value != value else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return str([plain(v) for v in value])
    return "None" if value is None else str(value)


def differences(spark, plan, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = plan(spark, sf_dir)
    names = sorted(got.columns)
    want = con.execute(sql)
    order = [d[0] for d in want.description]
    assert sorted(order) == names
    a = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    b = sorted(tuple(plain(r[order.index(n)]) for n in names) for r in want.fetchall())
    return [] if a == b else [x for x in a if x not in b][:3] + [x for x in b if x not in a][:3] + [(len(a), len(b))]
