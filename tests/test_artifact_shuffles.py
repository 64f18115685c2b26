"""Artifact faults: order across runs of places, ends that lack, and how often edges are shuffled."""

from lectern.operators import contracts
from tests.test_contracts import EDGE, GRAPH, NODE


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, turned):
    """A graph of 2,500 nodes and links between neighbours; ``turned`` and the place after it are swapped in both lists."""
    ids = [f"{k:05d}" for k in range(2500)]
    links = list(zip(ids, ids[1:], strict=False))
    for rows in (ids, links):
        if turned is not None:
            rows[turned], rows[turned + 1] = rows[turned + 1], rows[turned]
    nodes = [(1, k, i, i == "00007", "0" * 40 if i == "00007" else None, []) for k, i in enumerate(ids)]
    edges = [(1, k, a, b, "extends", "extends", 0.5, 0.5, "said", None) for k, (a, b) in enumerate(links)]
    return spark.createDataFrame([(1, "00007")], GRAPH), spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def _codes(df):
    return {(r["code"], r["path"]) for r in df.collect()} - {("provenance_shape", f"edges[{k}]") for k in range(3000)}


def test_order_across_runs(spark):
    assert _codes(contracts.artifact_faults(*_tables(spark, None))) == set()
    for turned in (0, 998, 999, 1000, 2497):
        assert _codes(contracts.artifact_faults(*_tables(spark, turned))) == {("node_order", "nodes"), ("edge_order", "edges")}


def test_an_edge_without_both_ends_counts_for_no_degree(spark):
    graphs, nodes, _ = _tables(spark, None)
    focal = nodes.replace("00009", "00010", "id").where("pos in (7, 10)")
    focal = focal.selectExpr("graph_id", "pos", "id", "true as is_focus", "sha1(id) as seed", "aliases")
    links = [("00007", "gone"), ("00007", "gone"), (None, "00007"), ("away", "gone"), ("00010", "00010"), ("00010", None)]
    edges = spark.createDataFrame([(1, k, a, b, "extends", "extends", 0.5, 0.5, "said", None) for k, (a, b) in enumerate(links)], EDGE)
    got = _codes(contracts.artifact_faults(graphs, focal, edges))
    assert {p for c, p in got if c == "edge_endpoint"} == {"edges[0]", "edges[1]", "edges[2]", "edges[3]", "edges[5]"}
    assert ("edge_duplicate", "edges[1]") in got
    assert ("root_deterministic", "root") in got


def test_edges_travel_without_what_no_join_reads(spark):
    """Before, checks of one edge alone were made after two joins, and lists were shuffled twice to be compared with themselves."""
    shuffled = [line for line in _plan(contracts.artifact_faults(*_tables(spark, None))).splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) <= 15
