"""Operators that SQL can't express, against plain Python; text columns against their definitions."""

import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import identity, scores, text, unicode
from lectern.operators import dedup, gates, graph, windows
from lectern.operators.components import connected_components
from lectern.sources import landed
from lectern.streaming import jobs


def value(spark, column, **cells):
    names, row = list(cells), tuple(cells.values())
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", bool: "boolean"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in cells.items())
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("column", "cells", "want"), [
    (lambda: text.abstract_preview(F.col("x"), 10), {"x": "one two three"}, "one two…"),
    (lambda: text.abstract_preview(F.col("x"), 20), {"x": "one two three"}, "one two three"),
    (lambda: text.formula_unguard(text.formula_guard(F.col("x"))), {"x": "=1+1"}, "=1+1"),
    (lambda: text.formula_guard(F.col("x")), {"x": "-1"}, "'-1"),
    (lambda: text.lenient_int(F.col("x")), {"x": " 12.9 "}, 12),
    (lambda: text.lenient_int(F.col("x")), {"x": "-3"}, -3),
    (lambda: text.lenient_int(F.col("x")), {"x": "3 papers"}, None),
    (lambda: text.duration_ms(F.col("x")), {"x": "1m30s"}, 90_000),
    (lambda: text.duration_ms(F.col("x")), {"x": "250ms"}, 250),
    (lambda: text.duration_ms(F.col("x")), {"x": "soon"}, None),
    (lambda: text.title_score(F.col("x"), F.col("y")), {"x": "Deep-Net!", "y": "deepnet"}, 1.0),
    (lambda: text.titles_diverge(F.col("x"), F.col("y")), {"x": "graph neural nets survey", "y": "protein folding at scale"}, True),
    (lambda: text.author_overlap(F.col("x"), F.col("y")), {"x": ["Ann Lee", "Bo Yu"], "y": ["A. Lee"]}, 1.0),
    (lambda: text.author_credit(F.col("x")), {"x": ["Ann Lee", "Bo Yu", "C Z"]}, "lee et al."),
    (lambda: text.slug(F.col("x")), {"x": "  Flash Attention: 2! "}, "flash-attention-2"),
    (lambda: text.single_word_typo(F.col("x"), F.col("y")), {"x": "a b c standard", "y": "a b c standart"}, True),
    (lambda: text.single_word_typo(F.col("x"), F.col("y")), {"x": "a b standard", "y": "a b standart"}, False),
    (lambda: text.bibtex_escape(F.col("x")), {"x": "a_b & 5%"}, "a\\_b \\& 5\\%"),
    (lambda: identity.doi(F.col("x")), {"x": "https://doi.org/10.1000/ABC"}, "10.1000/abc"),
    (lambda: identity.preprint_id(F.col("x")), {"x": "https://arxiv.org/pdf/2205.14135v2.pdf"}, "2205.14135"),
    (lambda: identity.work_id(F.col("x")), {"x": "https://openalex.org/W123"}, "W123"),
    (lambda: identity.uid(F.lit(None).cast("string"), F.col("x"), F.lit("u")), {"x": "10.1/X"}, "doi:10.1/x"),
    (lambda: identity.id_year(F.col("x")), {"x": "9913.00001"}, None),
    (lambda: identity.id_year(F.col("x")), {"x": "2205.14135"}, 2022),
    (lambda: unicode.round_exact(F.col("x"), F.lit(2)), {"x": 2.675}, 2.67),
    (lambda: unicode.html_unescape(F.col("x")), {"x": "a &amp; &#233;"}, "a & é"),
    (lambda: scores.velocity_score(F.lit(10), F.lit("2030-01-01").cast("date"), F.lit("2024-01-01").cast("date")), {"x": 1}, 100.0),
    (lambda: text.uniquifier(F.col("x")), {"x": 2}, "a"),
    (lambda: text.uniquifier(F.col("x")), {"x": 28}, "28"),
    (lambda: text.term_variants(F.col("x")), {"x": "boxes"}, ["boxes", "boxe", "box"]),
])
def test_columns(spark, column, cells, want):
    assert value(spark, column(), **cells) == want


def test_code_point_order_is_sparks(spark):
    words = ["b", "B", "é", "z", "😀", "ﬀ", "a"]
    got = [r["w"] for r in spark.createDataFrame([(w,) for w in words], "w string").orderBy("w").collect()]
    assert got == sorted(words)


def test_fuzzy_title(spark):
    for title in ("Ångström–ﬁeld  Études", "naïve", ""):
        plain = unicodedata.normalize("NFKC", "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c))).lower()
        want = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())
        assert " ".join(value(spark, unicode.fuzzy_title(F.col("x")), x=title).split()) == want


def random_graphs(seed, graphs=12):
    rng, rows = random.Random(seed), []
    for g in range(graphs):
        n = rng.randint(3, 8)
        for s, d in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                rows.append((g, g * 100 + s, g * 100 + d, 2000 + s, 2000 + d, rng.choice(["extends", "baseline_only"])))
    return rows


GRAPH = "graph_id long, src long, dst long, src_year long, dst_year long, relation string"


def all_paths(rows, start):
    nexts = [r[2] for r in rows if r[1] == start]
    return [[start, *p] for d in nexts for p in all_paths(rows, d)] or [[start]]


def test_main_path_against_enumeration(spark):
    rows = random_graphs(1)
    got = {}
    for r in graph.main_paths(spark.createDataFrame(rows, GRAPH)).orderBy("graph_id", "pos").collect():
        got.setdefault(r["graph_id"], []).append(r["node"])
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        sources = {r[1] for r in own} - {r[2] for r in own}
        paths = [p for s in sources for p in all_paths(own, s)]
        weight = {(r[1], r[2]): sum((r[1], r[2]) in zip(p, p[1:]) for p in paths) for r in own}
        counts = {(r[1], r[2]): {"extends": 3, "baseline_only": 1}[r[5]] for r in own}
        total = lambda p: sum(weight[e] * counts[e] for e in zip(p, p[1:]))
        assert got[g] in paths and total(got[g]) == max(map(total, paths))


def test_shortest_path_against_enumeration(spark):
    rows = random_graphs(2)
    ends = [(g, min(r[1] for r in rows if r[0] == g), max(r[2] for r in rows if r[0] == g)) for g in sorted({r[0] for r in rows})]
    got = {r["graph_id"]: r["cost"] for r in graph.shortest_paths(spark.createDataFrame(rows, GRAPH), spark.createDataFrame(ends, "graph_id long, first long, last long")).collect()}
    for g, first, last in ends:
        own = [r for r in rows if r[0] == g]
        cost = {(r[1], r[2]): 1 if r[5] == "extends" else 2 for r in own}
        chains = [q[: q.index(last) + 1] for q in all_paths(own, first) if last in q]
        costs = [sum(cost[e] for e in zip(p, p[1:])) for p in chains]
        assert got.get(g) == (min(costs) if costs else None)


MAIN = "graph_id long, src long, dst long, src_year long, dst_year long, relation string, confidence double"


def main_path_of(spark, rows):
    return [r["node"] for r in graph.main_paths(spark.createDataFrame(rows, MAIN)).orderBy("pos").collect()]


def test_main_path_turns_inverted_edges_and_keeps_parallel_ones(spark):
    chain = [(1, 1, 2, 2000, 2001, "extends", 0.9), (1, 2, 3, 2001, 2002, "extends", 0.9)]
    assert main_path_of(spark, chain) == [1, 2, 3]
    assert main_path_of(spark, [chain[0], (1, 3, 2, 2002, 2001, "extends", 0.9)]) == [1, 2, 3]
    fork = [(1, 1, 2, 2000, 2001, "baseline_only", 0.9), (1, 1, 3, 2000, 2001, "extends", 0.9), (1, 2, 4, 2001, 2002, "baseline_only", 0.9), (1, 3, 4, 2001, 2002, "extends", 0.9)]
    assert main_path_of(spark, fork) == [1, 3, 4]
    sure = [(1, 1, 2, 2000, 2001, "extends", 0.3), (1, 1, 3, 2000, 2001, "extends", 0.9), (1, 2, 4, 2001, 2002, "extends", 0.3), (1, 3, 4, 2001, 2002, "extends", 0.9)]
    assert main_path_of(spark, sure) == [1, 3, 4]
    parallel = [(1, 1, 2, 2000, 2001, "contrasts", 0.5), (1, 1, 2, 2000, 2001, "contrasts", 0.5), (1, 1, 3, 2000, 2001, "contrasts", 0.5), (1, 2, 4, 2001, 2002, "contrasts", 0.5), (1, 3, 4, 2001, 2002, "contrasts", 0.5)]
    assert main_path_of(spark, parallel) == [1, 2, 4]
    cycle = [(1, 1, 2, 2000, 2000, "extends", 0.5), (1, 2, 1, 2000, 2000, "extends", 0.5), (1, 2, 3, 2000, 2001, "extends", 0.5)]
    assert main_path_of(spark, cycle) == [1, 2, 3]


def plain_families(rows):
    near = {}
    for _, s, d, *_ in rows:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    best = None
    for gone in sorted(near):
        sizes, seen = [], {gone}
        for start in near:
            if start in seen:
                continue
            stack, size = [start], 0
            seen.add(start)
            while stack:
                size += 1
                for n in near[stack.pop()] - seen:
                    seen.add(n)
                    stack.append(n)
            sizes.append(size)
        sizes.sort(reverse=True)
        if len(sizes) > 1 and sizes[1] >= 2 and (best is None or sizes[1] > best[2]):
            best = (gone, sizes[0], sizes[1])
    return best


def test_families(spark):
    star = [(1, 1, 9, 0, 0, "x"), (1, 2, 9, 0, 0, "x"), (1, 2, 1, 0, 0, "x"), (1, 9, 10, 0, 0, "x"), (1, 10, 11, 0, 0, "x")]
    got = graph.families(spark.createDataFrame(star, GRAPH)).collect()
    assert [tuple(r) for r in got] == [(1, 9, 2, 2)]
    rng = random.Random(13)
    rows = [(g, *rng.sample(range(14), 2), 0, 0, "x") for g in range(60) for _ in range(rng.randrange(3, 16))]
    found = {r["graph_id"]: (r["node"], r["first"], r["second"]) for r in graph.families(spark.createDataFrame(rows, GRAPH)).collect()}
    for g in range(60):
        assert found.get(g) == plain_families([r for r in rows if r[0] == g])


def test_components(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + k, 501 + k) for k in range(60)] + [(None, 1), (7, 7)]
    parent = {x: x for r in rows if None not in r for x in r}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gates_and_windows(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "k string, v int"), spark.createDataFrame([("x", 1), ("y", 2), ("w", None)], "k string, v int")
    assert sorted(map(tuple, gates.diff(a, b, "k", "v").collect())) == [("w", "extra"), ("y", "changed"), ("z", "missing")]
    assert tuple(gates.shrink(a, b, "k", 0.9).first()) == (3, 3, 1, 1, False)
    assert windows.page(a, [F.asc("k")], 0, 2).count() == 2
    assert [tuple(r) for r in windows.mode(spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "g int, v string"), ["g"], "v").select("g", "v").collect()] == [(1, "a")]
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "src long, dst long")
    assert sorted(map(tuple, dedup.one_direction(edges, [F.asc("src")]).collect())) == [(1, 2), (3, 4)]


def test_bibtex_braces(spark):
    entry = "@article{k,\n title = {A {B {C}} d},\n author = \"X, Y\",\n year = 2020,\n abstract = {last}}"
    got = landed.bibtex_fields(spark.createDataFrame([(1, entry), (2, None)], "id int, e string"), "e", ["title", "author", "year", "abstract"]).orderBy("id").collect()
    assert tuple(got[0])[2:] == ("A {B {C}} d", "X, Y", "2020", "last") and tuple(got[1])[2:] == (None,) * 4


def test_csv_dict_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,"two\nlines",3\n4\n\n5,"say ""hi""",6,7\n')
    got = landed.csv_rows(spark, str(tmp_path / "x.csv"), "a string, b string, c string").collect()
    assert [tuple(r) for r in got] == [("1", "two\nlines", "3"), ("4", None, None), ("5", 'say "hi"', "6")]


def test_leases(spark):
    rows = [("u", k, f"2024-01-01 0{k}:00:00", k, False) for k in range(8)]
    df = spark.createDataFrame(rows, "user_id string, event_id long, ts string, owner long, done boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["event_id"] for r in jobs.leases(df, 3).collect() if r["outcome"] == "claimed") == [0, 3, 6]


def test_streamed_readiness_equals_the_fold(spark):
    from lectern.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    a, b = (sorted(map(tuple, QUERIES[n].plan(spark, sf).collect())) for n in ("readiness_states", "streamed_readiness"))
    assert a == b and {r[2] for r in a} >= {"unavailable", "stabilizing", "ready"}


def items(n, prefix="i"):
    return "\n".join(f"{prefix}{k}" for k in range(n))


def test_readiness_reducer():
    from lectern.streaming.readiness import EMPTY, Limits, reduce

    def told(*probes):
        state, seen = EMPTY, []
        for probe in probes:
            state, verdict = reduce(state, probe, Limits())
            seen.append(verdict)
        return seen

    a, b = ("snapshot", "a", items(20)), ("snapshot", "b", items(21))
    assert told((0, 1, *a), (1, 2, *a), (8, 3, *a), (9, 4, *b), (9, 4, *b), (5, 5, *b)) == ["stabilizing", "stabilizing", "ready", "stabilizing", "repeat", "late"]
    assert told((0, 1, *a), (1, 2, "failed", "", ""), (7, 3, *a)) == ["stabilizing", "failed", "ready"]
    assert told((0, 1, *a), (1, 2, "unavailable", "", ""), (7, 3, *a)) == ["stabilizing", "unavailable", "stabilizing"]
    assert told((0, 1, *a), (300, 2, *a), (310, 3, *a)) == ["stabilizing", "stabilizing", "ready"]
    assert told((0, 1, "publish", "", ""), (1, 2, *a), (8, 3, *a), (9, 4, "publish", "", "")) == ["refused", "stabilizing", "ready", "published"]
    live = [(1, 2, *a), (8, 3, *a), (9, 4, "publish", "", "")]
    assert told(*live, (10, 5, *a), (11, 6, "unavailable", "", ""), (12, 7, *b), (19, 8, *b))[3:] == ["published", "published", "stabilizing", "ready"]
    assert told(*live, (10, 5, "snapshot", "c", items(19)))[3:] == ["anomaly"]
    assert told(*live, (10, 5, "snapshot", "c", items(25, "j")))[3:] == ["anomaly"]


def plain_quota(requests, key_hour=5, hour=10, day=40):
    """Every request in order against dictionaries of counts."""
    windows, hours, days, out = {}, {}, {}, {}
    for number, key, at in sorted(requests, key=lambda r: (r[2], r[0])):
        h, d = int(at // 3600), int(at // 86400)
        count, end = windows.get(key, (0, -1.0))
        if end <= at:
            count, end = 0, at + 3600
        if days.get(d, 0) >= day:
            out[number] = "global_day"
        elif hours.get(h, 0) >= hour:
            out[number] = "global_hour"
        elif count >= key_hour:
            out[number] = "key"
        else:
            out[number] = "ok"
            windows[key] = count + 1, end
            hours[h], days[d] = hours.get(h, 0) + 1, days.get(d, 0) + 1
    return out


def test_quota_charges_allowed_requests_only_and_windows_cross_midnight(spark):
    from lectern.streaming import quota

    rng, rows = random.Random(11), []
    for k in range(1500):
        at = 86400 * 3 + rng.choice([rng.random() * 86400 * 4, 86400 * rng.randrange(1, 4) - 1800 + rng.random() * 3600])
        rows.append((k, str(rng.choice([1, 1, 1, rng.randrange(30)])), round(at, 3)))
    rows += [(5000 + k, "midnight", 86400 * 20 - 60.0 + 20 * k) for k in range(12)]
    frame = spark.createDataFrame(rows, "id long, key string, at double").withColumn("at", F.col("at").cast("timestamp"))
    got = dict(quota.consume(frame).collect())
    assert got == plain_quota(rows) and set(got.values()) == {"ok", "key", "global_hour", "global_day"}
    assert [got[5000 + k] for k in range(12)] == ["ok"] * 5 + ["key"] * 7
    assert quota.consume(frame.limit(0)).count() == 0


def test_quota_on_the_given_table(spark):
    from lectern.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r[0], str(r[1]), r[2]) for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double")).collect()]
    assert dict(QUERIES["fixed_hour_quota"].plan(spark, sf).collect()) == plain_quota(rows)


def test_alert_decisions():
    from lectern.streaming.alerts import decide

    state, seen = ("", 0.0), []
    for problems, at in [("", 0), ("a", 1), ("a", 5), ("a", 11), ("a", 12), ("a\nb", 13), ("", 14), ("", 15), ("a", 16)]:
        state, decision = decide(state, problems, at, 10)
        seen.append(decision)
    assert seen == ["none", "new", "none", "reminder", "none", "new", "resolved", "none", "new"]


def test_lease_is_released_by_its_owner_only(spark):
    from lectern.streaming.jobs import leases

    hour = 3600
    moves = [(1, 0, "a", False), (2, hour, "b", False), (3, 2 * hour, "b", True), (4, 3 * hour, "a", True), (5, 4 * hour, "b", False), (6, 11 * hour, "a", False)]
    frame = spark.createDataFrame([(1, e, t, o, d) for e, t, o, d in moves], "user_id long, event_id long, ts long, owner string, done boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert dict(leases(frame, 6).collect()) == {1: "claimed", 2: "held", 3: "not_owner", 4: "released", 5: "claimed", 6: "claimed"}


def test_link_passes(spark):
    from lectern.operators.linking import link

    rows = spark.createDataFrame([(1, "On big standard nets", ["Ann Lee"]), (2, "On big standart things", ["Bo Yu"]), (3, "A title about the same nets", ["C D", "E F"]), (4, "Only here", ["X Y"])], "id long, title string, authors array<string>")
    records = spark.createDataFrame([(10, "On Big Standard Nets!", ["A. Lee"]), (20, "On big standard things", ["B. Yu"]), (30, "Other title about nets", ["E F", "C D"]), (40, "only here", ["Q Z"])], "record long, title string, authors array<string>")
    assert sorted(map(tuple, link(rows, records).collect())) == [(1, 10, 1), (2, 20, 1), (3, 30, 2), (4, 40, 3)]


def test_merge_title_years(spark):
    rows = spark.createDataFrame([(1, "t", 2000, None, 5.0), (2, "t", 2002, None, 9.0), (3, "t", 2004, None, 1.0), (4, "t", 2010, None, 1.0), (5, "u", 1990, "d", 1.0), (6, "v", 1999, "d", 0.0)], "id long, title_key string, year long, doi string, cites double")
    assert dict(dedup.merge_title_years(rows).collect()) == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5}
