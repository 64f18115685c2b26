"""Guards of theme graphs against plain walks over each graph."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.operators import fixpoint, graph
from lectern.plans import queries_guards

KINDS = "graph_id int, node int, kind string, z double"
EDGES = "graph_id int, src int, dst int, relation string, method string"
WEAK = ("weak_subject", "weak_mention")


def plain_guard(kinds, edges):
    """Round by round, with the lenders of each round found anew."""
    live, out = dict(kinds), {}
    for turn in range(1, 10_000):
        near, cued = defaultdict(set), set()
        for src, dst, relation, method in edges:
            if src != dst and src in live and dst in live:
                near[src].add(dst)
                near[dst].add(src)
                if relation in fixpoint.CLAIMS and method not in fixpoint.CUELESS:
                    cued |= {src, dst}
        weak = [n for n, k in live.items() if k in WEAK]
        passing = {n for n in weak if n in cued or live[n] == "weak_subject" and sum(live[o] != "weak_mention" for o in near[n]) >= 2}
        reached = {n for n, k in live.items() if k == "lender"} | passing
        todo = list(reached)
        while todo:
            for o in near[todo.pop()]:
                if o not in reached and live[o] in WEAK:
                    reached.add(o)
                    todo.append(o)
        gone = [n for n in weak if near[n] and n not in passing and n not in reached]
        if not gone:
            return out
        for n in gone:
            out[n] = ("single_link" if live.pop(n) == "weak_subject" else "uncorroborated", turn)


def check(kinds, edges, found):
    by_graph, links = defaultdict(dict), defaultdict(list)
    for r in kinds.collect():
        by_graph[r["graph_id"]][r["node"]] = r["kind"]
    for r in edges.collect():
        links[r["graph_id"]].append((r["src"], r["dst"], r["relation"], r["method"]))
    want = {(g, n): v for g, ks in by_graph.items() for n, v in plain_guard(ks, links[g]).items()}
    rows = found.collect()
    assert {(r["graph_id"], r["node"]): (r["rule"], r["round"]) for r in rows} == want and len(rows) == len(want)
    return want


def test_weak_entries_of_random_graphs(spark):
    r = random.Random(4)
    kinds, edges = [], []
    for g in range(60):
        size = r.randrange(2, 14)
        kinds += [(g, n, r.choice(["seed", "support", "lender", "inert", *WEAK * 4]), 0.1) for n in range(size)]
        edges += [(g, r.randrange(size + 1), r.randrange(size), r.choice(["extends", "baseline_only", "baseline_only", "baseline_only"]), r.choice(["api_rules", "api_citation", "api_citation", None])) for _ in range(r.randrange(2 * size))]
    kinds, edges = spark.createDataFrame(kinds, KINDS), spark.createDataFrame(edges, EDGES)
    want = check(kinds, edges, fixpoint.confirm_weak(kinds, edges))
    assert len(want) > 30


def test_rounds_follow_one_another(spark):
    """A subject held by two links loses one, and with it the other's support."""
    kinds = spark.createDataFrame([(1, 0, "seed", None), (1, 1, "weak_subject", 0.1), (1, 2, "weak_subject", 0.2), (1, 3, "weak_subject", 0.3), (1, 9, "weak_mention", 0.0)], KINDS)
    edges = spark.createDataFrame([(1, 1, 2, "baseline_only", None), (1, 2, 3, "baseline_only", None), (1, 3, 4, "extends", None), (1, 3, 9, "baseline_only", None)], EDGES)
    check(kinds, edges, fixpoint.confirm_weak(kinds, edges))
    assert fixpoint.confirm_weak(kinds.limit(0), edges).count() == 0 and fixpoint.confirm_weak(kinds, edges.limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="still"):
        fixpoint.confirm_weak(kinds, edges, most=0)


def test_weak_entry_query(spark):
    kinds, edges = queries_guards.weak_entry_rows(spark, "/root/testdata/sf0.001")
    assert check(kinds, edges, queries_guards.weak_entries(spark, "/root/testdata/sf0.001"))


def plain_gate(nodes, edges, least):
    near, cites, cited = defaultdict(set), defaultdict(set), defaultdict(set)
    for src, dst in edges:
        near[src].add(dst)
        near[dst].add(src)
        cites[dst].add(src)
        cited[src].add(dst)
    focus = {n for n, v in nodes.items() if v["focus"]}
    descends = {n for n in nodes if n not in focus and cites[n] & focus and not cited[n] & focus}
    reason, rule = {}, {}
    for n, v in nodes.items():
        if n in focus:
            reason[n] = f"focus({v['role']})"
        elif n in descends and v["role"] == "subject":
            reason[n] = "topic(descendant)"
        elif n not in descends and v["on_topic"]:
            reason[n] = "topic"
    lends = {n for n, why in reason.items() if why.startswith("topic")}
    support = {n: len(near[n] & lends) for n in nodes}
    for n, v in nodes.items():
        if n in reason:
            continue
        if n in descends:
            if v["role"] != "none" and support[n] >= least:
                reason[n] = "support(descendant)"
            else:
                rule[n] = f"descendant({v['role']})"
        elif support[n] >= least and not v["dataset"]:
            reason[n] = "support"
        else:
            rule[n] = "support(dataset)" if v["dataset"] else "support"
    changed = True
    while changed:
        changed = False
        for n in [n for n in reason if n not in focus]:
            if not any(o != n and o in reason for o in near[n]):
                del reason[n]
                rule[n], changed = "edgeless", True
    return {n: (n in reason, reason.get(n) or rule[n], support[n]) for n in nodes}


def test_gate_of_random_graphs(spark):
    r = random.Random(8)
    nodes, edges = [], []
    for g in range(40):
        size = r.randrange(2, 12)
        nodes += [(g, n, r.random() < 0.2, r.choice(["subject", "component", "abstract", "none"]), r.random() < 0.4, r.random() < 0.2) for n in range(size)]
        edges += [(g, r.randrange(size), r.randrange(size)) for _ in range(r.randrange(2 * size))]
    n = spark.createDataFrame(nodes, "graph_id int, node int, focus boolean, role string, on_topic boolean, dataset boolean")
    e = spark.createDataFrame(edges, "graph_id int, src int, dst int")
    got = {(x["graph_id"], x["node"]): (x["kept"], x["reason"], x["support"]) for x in fixpoint.readmit(n, e, 2).collect()}
    want = {}
    for g in range(40):
        own = {m: {"focus": f, "role": role, "on_topic": t, "dataset": d} for q, m, f, role, t, d in nodes if q == g}
        want |= {(g, m): v for m, v in plain_gate(own, [(s, d) for q, s, d in edges if q == g], 2).items()}
    assert got == want
    rank = F.when(F.col("role") == "subject", 3).otherwise(1)
    roots = {x["graph_id"]: x["node"] for x in fixpoint.topical_root(n, e, rank).collect()}
    assert set(roots) == {g for g, _, f, *_ in nodes if f}


def test_depth_does_not_stop_short(spark):
    nodes, chain = spark.range(8).select(F.col("id").alias("node")), spark.range(7).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["node"]: r["depth"] for r in graph.longest_depth(nodes, chain, most=8).collect()} == {n: n for n in range(8)}
    for edges, most in ((chain, 6), (chain.unionByName(spark.createDataFrame([(7, 0)], "src long, dst long")), 50)):
        with pytest.raises(RuntimeError, match="chain"):
            graph.longest_depth(nodes, edges, most=most)
