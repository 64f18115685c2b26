"""Year lines against a plain walk, and focused views on graphs small enough to follow by hand."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.plans import queries_layout

SF = "/root/testdata/sf0.001"


def plain_lines(row, edges, per_line):
    """row: nodes from left to right; edges of the whole graph."""
    inside = [(s, d) for s, d, relation in edges if s != d and s in row and d in row and relation != "baseline_only"]

    def depth(n, seen=()):
        return max([1 + depth(s, (*seen, n)) for s, d in inside if d == n and s not in seen], default=0)

    line, used = {}, Counter()
    for n in sorted(row, key=lambda n: (depth(n), row.index(n))):
        at = max([line[s] + 1 for s, d in inside if d == n and s in line], default=0)
        while used[at] >= per_line:
            at += 1
        used[at] += 1
        line[n] = at
    out = {}
    for n in row:
        out[n] = (line[n], sum(line[m] == line[n] for m in row[: row.index(n)]), max(line.values()) + 1)
    return out


def test_lines_of_random_graphs(spark):
    r, nodes, edges, want = random.Random(3), [], [], {}
    for g in range(50):
        size, per_line = r.randrange(1, 14), 3
        order = r.sample(range(size), size)
        years = {n: r.choice([2000, 2001, None]) for n in order}
        own = [(*sorted(r.sample(range(size), 2)), r.choice(["extends", "baseline_only"])) for _ in range(size) if size > 1]
        nodes += [(g, n, years[n], k) for k, n in enumerate(order)]
        edges += [(g, *e) for e in own]
        for year in set(years.values()):
            want |= {(g, n): v for n, v in plain_lines([n for n in order if years[n] == year], own, per_line).items()}
    got = layout.year_lines(spark.createDataFrame(nodes, "graph_id int, node int, year int, place int"), spark.createDataFrame(edges, "graph_id int, src int, dst int, relation string"), 3)
    assert {(x["graph_id"], x["node"]): (x["line"], x["column"], x["lines"]) for x in got.collect()} == want


def test_layout_of_one_graph(spark):
    nodes = spark.createDataFrame([(1, 1, 2000, 9), (1, 2, 2000, 8), (1, 3, 2000, 7), (1, 4, 2001, 5), (1, 5, None, 1)], "graph_id int, node int, year int, price int")
    edges = spark.createDataFrame([(1, 1, 3, "extends"), (1, 2, 3, "baseline_only"), (1, 3, 3, "extends")], "graph_id int, src int, dst int, relation string")
    got = {r["node"]: (r["x"], r["y"], r["width"], r["height"]) for r in layout.chronological(nodes, edges, 2, [F.desc("price")]).collect()}
    top = 56 + 200 + 36 + 200 + 80
    assert got == {1: (112, 56, 716, top + 2 * 280 + 56), 2: (400, 56, 716, top + 616), 3: (112, 292, 716, top + 616), 4: (112, top, 716, top + 616), 5: (112, top + 280, 716, top + 616)}
    cyclic = spark.createDataFrame([(1, 1, 2, "extends"), (1, 2, 1, "extends")], "graph_id int, src int, dst int, relation string")
    assert layout.chronological(nodes, cyclic, 2, [F.desc("price")]).count() == 5 and layout.chronological(nodes.limit(0), edges, 2, [F.desc("price")]).count() == 0


def test_layout_query(spark):
    nodes, edges = queries_layout.drawn(spark, SF)
    rows, links = defaultdict(list), defaultdict(list)
    for r in nodes.orderBy(F.desc("price"), "node").collect():
        rows[r["graph_id"], r["year"]].append(r["node"])
    for r in edges.collect():
        links[r["graph_id"]].append((r["src"], r["dst"], r["relation"]))
    want = {n: v for (g, _), row in rows.items() for n, v in plain_lines(row, links[g], 3).items()}
    tops = {}
    for g in {g for g, _ in rows}:
        top = 56
        for year in sorted((y for q, y in rows if q == g), key=lambda y: (y is None, y)):
            tops[g, year], lines = top, want[rows[g, year][0]][2]
            top += lines * 236 - 36 + 80
    for r in queries_layout.year_layout(spark, SF).collect():
        line, column, _ = want[r["node"]]
        assert (r["x"], r["y"]) == (112 + column * 288, tops[r["graph_id"], r["year"]] + line * 236)


CLAIMS = "graph_id int, id int, src int, dst int, decision string, trust string, family string, relation string, probability double, sources array<string>, kinds array<string>"


def view(spark, rows, focus=5, expanded=(), **asked):
    full = [(1, i, s, d, "accepted", t, f, r, p, ["refs"], ["quote"]) for i, s, d, t, f, r, p in rows]
    found = layout.focus_projection(spark.createDataFrame(full, CLAIMS), spark.createDataFrame([(1, focus, list(expanded))], "graph_id int, node int, expanded array<int>"), layout.View(**asked)).collect()
    assert len(found) == len(rows)
    return [r["id"] for r in sorted(found, key=lambda r: (r["shown"] is None, r["shown"])) if r["shown"] is not None], {r["id"]: r["reason"] for r in found if r["reason"]}


V, G = "verified", "genealogy"


def test_spine_then_branches(spark):
    rows = [(1, 4, 5, V, G, "extends", 0.1), (2, 3, 5, V, G, "extends", 0.9), (3, 5, 6, V, G, "extends", 0.5), (4, 6, 7, V, G, "extends", 0.5), (5, 2, 5, V, G, "contrasts", 0.05), (6, 1, 5, V, G, "contrasts", 0.01)]
    shown, out = view(spark, rows)
    assert shown == [2, 3, 1, 5] and out == {4: "hop", 6: "branch"}
    assert view(spark, rows, hops=2)[0] == [2, 3, 4, 1, 5]
    assert view(spark, rows, expanded=[5])[0] == [2, 3, 1, 5, 6] and view(spark, rows, expanded=[99])[0] == [2, 3, 1, 5]


def test_budgets_and_reasons(spark):
    rows = [(1, 4, 5, V, G, "extends", 0.9), (2, 3, 5, V, G, "extends", 0.8), (3, 2, 5, V, G, "extends", 0.7), (4, 3, 4, V, G, "extends", 0.2)]
    assert view(spark, rows, nodes=3) == ([1, 2, 4], {3: "node_cap"})
    assert view(spark, rows, claims=2) == ([1, 2], {3: "claim_cap", 4: "claim_cap"})
    assert view(spark, rows, nodes=1)[0] == []


def test_filters_in_order(spark):
    base = {"graph_id": 1, "src": 4, "dst": 5, "decision": "accepted", "trust": V, "family": G, "relation": "extends", "probability": None, "sources": ["refs"], "kinds": ["quote"]}
    changes = [{}, {"decision": "no", "trust": "tentative"}, {"trust": "tentative", "family": "x"}, {"family": "x", "relation": None}, {"relation": None}, {"trust": "corroborated", "sources": []}, {"trust": "corroborated", "probability": 0.4}, {"sources": []}, {"sources": None}, {"kinds": ["table"]}]
    df = spark.createDataFrame([{**base, "id": k, **x} for k, x in enumerate(changes)], CLAIMS)
    asked = layout.View(sources=("refs",), kinds=("quote",), least_confidence=0.5)
    got = {r["id"]: r["reason"] for r in df.select("id", layout.first_reason(asked).alias("reason")).collect()}
    assert got == {0: None, 1: "decision", 2: "trust", 3: "family", 4: "relation", 5: "confidence", 6: "confidence", 7: "evidence", 8: "evidence", 9: "evidence"}


def test_tentative_and_comparisons(spark):
    rows = [(1, 4, 5, V, G, "extends", 0.9), (2, 4, 6, "tentative", G, "extends", 0.5), (3, 8, 9, "tentative", G, "extends", 0.9), (4, 4, 5, V, "comparison", "contrasts", 0.5), (5, 5, 7, V, "comparison", "contrasts", 0.4), (6, 4, 7, V, "comparison", "contrasts", 0.3), (7, 4, 10, V, "comparison", "contrasts", 0.3)]
    shown, out = view(spark, rows, trust=layout.TRUST)
    assert shown == [1, 2, 4, 5, 6] and out == {3: "hop", 7: "branch"}
    assert view(spark, rows, trust=layout.TRUST, extras=1)[0] == [1, 2, 4] and 2 not in view(spark, rows)[0]


def test_views_of_all_graphs(spark):
    rows, focus = queries_layout.claims(spark, SF)
    found = queries_layout.focus_views(spark, SF)
    asked, by_graph = queries_layout.VIEW, defaultdict(list)
    ends = {r["id"]: r for r in rows.collect()}
    centre = {r["graph_id"]: r["node"] for r in focus.collect()}
    got = found.collect()
    assert Counter(r["id"] for r in got) == Counter(i for i, r in ends.items() if r["graph_id"] in centre)
    for r in got:
        assert (r["shown"] is None) != (r["reason"] is None)
        if r["shown"] is not None:
            by_graph[r["graph_id"]].append((r["shown"], ends[r["id"]]))
    assert len({r["reason"] for r in got}) > 6
    for g, shown in by_graph.items():
        assert sorted(k for k, _ in shown) == list(range(len(shown)))
        tied = {centre[g]}
        for _, c in sorted(shown, key=lambda x: x[0]):
            assert tied & {c["src"], c["dst"]} and c["relation"] in asked.relations and c["decision"] == "accepted"
            tied |= {c["src"], c["dst"]}
    assert layout.focus_projection(rows.limit(0), focus, asked).count() == 0
