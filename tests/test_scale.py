"""Queries that met all rows of a key pair by pair: the same results from what agrees."""

from pyspark.sql import functions as F


def test_version_increments_are_those_of_all_pairs(spark):
    from lectern.operators.classify import is_version_increment, version_increments

    titles = ["net", "net v2", "Net 3", "net v21", "improved net", "better net v2", "improved improved net", "net-2", "", None, "improved 2", "tree v2"]
    rows = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(titles * 4)], "id long, shop int, title string")
    a, b = rows.alias("a"), rows.alias("b")
    want = a.join(b, (F.col("a.shop") == F.col("b.shop")) & (F.col("a.id") < F.col("b.id"))).where(is_version_increment(F.col("a.title"), F.col("b.title"))).select("a.id", "b.id")
    got = version_increments(rows, ["shop"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) > 20


def test_versioned_pairs_with_repeated_words_are_those_of_the_sql(spark, tmp_path):
    import random

    from lectern.plans.catalogue import QUERIES
    from tests.oracle import TABLES

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    rng = random.Random(3)
    part = spark.read.parquet(str(tmp_path / "part.parquet"))
    names = ["ring ring", "ring", "ring bolt", "ring bolt ring", "ring bolt wide", "bolt ring", "ring wide bolt long"]
    rows = [(k, rng.choice(names), f"Brand#{k % 2}", "SMALL", rng.randrange(1, 8), 1.0) for k in range(120)]
    (tmp_path / "part.parquet").unlink()
    spark.createDataFrame(rows, part.schema).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    q = QUERIES["versioned_pairs"]
    found = q.plan(spark, str(tmp_path))
    assert found.count() > 100

    import duckdb

    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(q.sql).fetchall())


def test_similar_sets_of_all_sizes_meet_by_several_items(spark):
    import random

    from lectern.operators.matching import _picks, similar_sets

    rng = random.Random(5)
    sets = []
    for k in range(260):
        base = sets[rng.randrange(len(sets))][1] if sets and rng.random() < 0.7 else rng.sample(range(90), rng.choice([1, 2, 3, 5, 8, 12, 20, 24, 25, 30, 45]))
        sets.append((k, sorted({x if rng.random() < 0.85 else rng.randrange(90) for x in base} | ({7} if rng.random() < 0.6 else set()))))
    rows = spark.createDataFrame([(k, [f"w{x}" for x in s]) for k, s in sets], "id long, items array<string>")
    for over, under in ((3, 5), (4, 5), (1, 4)):
        want = {(i, j) for i, x in sets for j, y in sets if i < j and len({*x} & {*y}) * under >= len({*x} | {*y}) * over and {*x} & {*y}}
        assert {(r["a"], r["b"]) for r in similar_sets(rows, over, under).collect()} == want and len(want) > 50
    assert all(j is not None for n, m, i, j, _ in _picks(3, 5) if n >= 2 and m >= 2)


def test_groups_stream_whole_through_small_batches(spark):
    from lectern.operators.groups import in_groups

    rows = spark.createDataFrame([(k % 11, k) for k in range(400)] + [(None, 1000), (None, 1001)], "g long, v long")
    like = spark.createDataFrame([], "g long, n long, s string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = in_groups(rows, lambda group: [(group[0][0], len(group), None if r[1] % 2 else str(r[1])) for r in group[:2]], like).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["g"] if r["g"] is not None else -1, r["n"]) for r in got) == sorted([(g, len(range(g, 400, 11))) for g in range(11)] * 2 + [(-1, 2)] * 2)


def test_title_year_merge_is_the_plain_walk(spark):
    import random

    from lectern.operators.dedup import merge_title_years

    rng = random.Random(11)
    rows = [(k, f"t{rng.randrange(9)}", rng.choice([None, *range(1990, 2006)]), rng.choice([None, "", "x", "y", "z"]), float(rng.randrange(5))) for k in range(300)]
    alive, into = [], {}
    for row in rows:
        match = next((n for n, x in enumerate(alive) if (row[3] and row[3] == x[3]) or (row[1] == x[1] and (row[2] is None or x[2] is None or abs(row[2] - x[2]) <= 2))), None)
        if match is None:
            alive.append(row)
            continue
        kept, gone = (row, alive[match]) if row[4] > alive[match][4] else (alive[match], row)
        alive[match] = kept
        into[gone[0]] = kept[0]

    def final(i):
        while i in into:
            i = into[i]
        return i

    df = spark.createDataFrame(rows, "id long, title_key string, year int, doi string, cites double")
    assert dict(merge_title_years(df).collect()) == {r[0]: final(r[0]) for r in rows} and len(into) > 200


def test_only_versions_are_the_single_versioned_pairs(spark):
    import random

    from lectern.operators.records import only_versions, versioned_pairs

    rng = random.Random(2)
    rows = [(k, rng.choice(["A", "B", None]), rng.sample(["a", "b", "c", "d"], rng.randrange(1, 4)), rng.choice([2000, 2001, 2003, None]), ["Ann Lee", rng.choice(["Bo Yu", "Cy Fox"])],
             rng.choice([None, f"p{k}"]), rng.choice([None, "10.9/1", "10.9/2", "10.48550/7"])) for k in range(60)]
    rows += [(100 + r[0], *r[1:]) for r in rows[:8]]
    papers = spark.createDataFrame(rows, "id long, prefix string, subtitle array<string>, year int, authors array<string>, preprint string, doi string")
    by = {}
    for r in versioned_pairs(papers).collect():
        by.setdefault(r["a"], set()).add(r["b"])
    want = sorted((a, *b) for a, b in by.items() if len(b) == 1)
    assert sorted(map(tuple, only_versions(papers).collect())) == want and want


def test_inverted_indexes_shuffle_nothing_and_keep_places(spark):
    from lectern.operators.inverted import inverted_indexes

    found = inverted_indexes(spark.createDataFrame([(1, "b a b"), (2, None), (3, "x")], "id long, text string"))
    assert {r["id"]: r["index"] for r in found.collect()} == {1: {"b": [0, 2], "a": [1]}, 2: None, 3: {"x": [0]}}


def test_linked_records_are_those_of_all_pairs(spark):
    import random

    from pyspark.sql import Window

    from lectern.functions.text import author_overlap, compact_key, single_word_typo, title_score
    from lectern.operators.linking import _best, accepted

    rng = random.Random(11)
    titles = ["on standard nets of trees", "on standart nets of trees", "On standard, nets of trees", "—", "…", "", None, "measured things", "measured-things"]
    people = ["Ann Lee", "Bo Yu", "Cy Fox", "Di Orr", "Ed  Lee", "Flo", "", None, "Gus Ito", "Hal Kim", "Ivy Roy"]

    def drawn(n):
        return [(k, rng.choice(titles), None if rng.random() < 0.05 else rng.sample(people, rng.choice([0, 1, 2, 2, 3, 5, 8, 10]))) for k in range(n)]

    rows = spark.createDataFrame(drawn(160), "id long, title string, authors array<string>")
    records = spark.createDataFrame(drawn(140), "record long, title string, authors array<string>")
    a, b = (df.withColumns({"k": compact_key(F.col("title")), "b": F.lit("x")}) for df in (rows, records))
    left, right = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)) for p, df in (("l", a), ("r", b)))
    score, overlap = title_score(F.col("l_title"), F.col("r_title")), author_overlap(F.col("l_authors"), F.col("r_authors"))
    typo = (F.col("l_k") != F.col("r_k")) & single_word_typo(F.lower("l_title"), F.lower("r_title")) & (overlap >= 0.5)
    every = left.join(right, ((F.col("l_k") == F.col("r_k")) & accepted(score, overlap)) | typo)
    rank = F.row_number().over(Window.partitionBy("l_id").orderBy(score.desc(), overlap.desc(), "r_record"))
    want = every.withColumn("_r", rank).where("_r = 1").select("l_id", "r_record").collect()
    assert sorted(map(tuple, _best(a, b).collect())) == sorted(map(tuple, want)) and len(want) > 60


def test_records_that_share_a_title_are_not_met_pair_by_pair(spark):
    import time

    from lectern.operators.linking import link

    many = 20_000
    rows = spark.range(many).select("id", F.lit("on things").alias("title"), F.array(F.concat(F.lit("Lee"), F.col("id") % 3)).alias("authors"))
    began = time.time()
    found = link(rows, rows.withColumnRenamed("id", "record")).collect()
    assert sorted((r["id"], r["record"], r["pass"]) for r in found) == [(k, k % 3, 1) for k in range(many)]
    assert time.time() - began < 100, "400 million pairs take far longer"


def test_ranks_of_streamed_graphs_are_those_of_rounds(spark):
    import random

    from lectern.operators.graph import pagerank

    rng = random.Random(2)
    nodes = [(g, 100 * g + k) for g in range(12) for k in range(1 + 3 * g)]
    edges = [(g, a, rng.choice([n for h, n in nodes if h == g])) for g, a in nodes for _ in range(rng.randrange(3))] + [(3, 300, 301), (3, 300, 301), (3, 302, None), (4, None, 401), (5, 777, 501)]
    n, e = spark.createDataFrame(nodes, "graph_id long, node long"), spark.createDataFrame(edges, "graph_id long, src long, dst long")
    found = [{r["node"]: round(r["rank"], 9) for r in pagerank(n, e, most=most).collect()} for most in (0, 30, 10_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(nodes)


def test_large_order_tables_are_dealt_by_their_rows(spark):
    from lectern.operators.catalog import set_losses
    from lectern.plans.storage import parts_of

    assert parts_of(2_000_000) is None and parts_of(54_000_000) == 108
    a = spark.range(10).select(F.lit("n").alias("kind"), F.struct("id").alias("item"))
    b = spark.range(3, 15).select(F.lit("n").alias("kind"), F.struct("id").alias("item"))
    assert [tuple(r) for r in set_losses(a, b, ["n"], 7).collect()] == [("n", 3, 5)]


def test_edges_outside_a_lineage_are_told_once(spark):
    from lectern.operators.lineage import build, contract

    nodes = spark.createDataFrame([(1, 1, True), (1, 2, False)], "graph_id long, id long, is_root boolean")
    edges = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 9, 0.5), (1, 8, 9, 0.5), (1, 9, 2, 0.5)], "graph_id long, src long, dst long, confidence double")
    assert {r["kind"]: r["violations"] for r in contract(nodes, edges).collect()}["endpoints"] == 3
    papers = spark.createDataFrame([(1, 1, 2000, 1e6, True), (1, 2, 2001, 1e6, False), (1, 3, 2002, 1e6, False)], "graph_id long, id long, year long, impact double, is_focus boolean")
    links = spark.createDataFrame([(1, 1, 2, 2001, "extends", "cites it"), (1, 1, 3, 2002, "extends", " no   ")], "graph_id long, src long, dst long, dst_year long, relation string, rationale string")
    kept, told = build(papers, links, F.lit(False))
    assert {r["id"] for r in kept.collect()} == {1, 2} and set(told.columns) == {"graph_id", "src", "dst", "relation", "confidence"}
