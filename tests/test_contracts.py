"""Contracts on small graphs and snapshots, each odd case by itself, and publication in two phases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import contracts, snapshots
from lectern.sources import published

A, B, C = "a" * 40, "b" * 40, "c" * 40
GRAPH = "graph_id long, root string"
NODE = "graph_id long, pos long, id string, is_focus boolean, seed string, aliases array<struct<namespace:string,source_id:string>>"
EDGE = "graph_id long, pos long, src string, dst string, relation string, rel string, confidence double, conf double, rationale string, provenance string"


def provenance(drop=(), **changes):
    parts = {"producer": {"name": "b", "version": "1"}, "evidence": {"source": "s", "kind": "k", "sha256": "0" * 64}, "classification": {"method": "intent_map", "provider": None, "model": None, "prompt_version": None, "schema_version": "1"}}
    for path, value in changes.items():
        part, _, name = path.partition("__")
        if name:
            parts[part][name] = value
        else:
            parts[part] = value
    return json.dumps({k: v for k, v in parts.items() if k not in drop})


def edge(pos, src, dst, relation="extends", rel=None, confidence=0.5, conf=None, rationale="why", said=None, graph=1):
    return graph, pos, src, dst, relation, rel or relation, confidence, confidence if conf is None else conf, rationale, said or provenance()


def faults(spark, roots, nodes, edges):
    rows = contracts.artifact_faults(spark.createDataFrame(roots, GRAPH), spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)).collect()
    return sorted((r["graph_id"], r["code"], r["path"]) for r in rows)


def node(pos, id_, focus=False, seed=None, aliases=None, graph=1):
    return graph, pos, id_, focus, seed, aliases


def test_sound_and_empty_graphs(spark):
    nodes = [node(0, "a", True, A), node(1, "b", True, B), node(2, "c")]
    edges = [edge(0, "a", "b"), edge(1, "b", "c")]
    assert faults(spark, [(1, "b")], nodes, edges) == []
    assert faults(spark, [(1, "a")], nodes, edges) == [(1, "root_deterministic", "root")]
    assert faults(spark, [], [], []) == [] and faults(spark, [(3, None)], [], []) == []
    assert faults(spark, [(3, "x")], [], []) == [(3, "empty_root", "root"),]


def test_node_faults(spark):
    nodes = [node(0, "b", True, A, [("doi", "10.1/x"), ("doi", "10.1/x")]), node(1, "a", True, A, [("doi", "10.1/X"), ("other", "y"), ("arxiv", None)]), node(2, "a", None, "short"), node(3, "c", False, C, [("arxiv", "1"), ("arxiv", "2")]), node(4, "d", False, None, [("arxiv", "1")])]
    got = faults(spark, [(1, "a")], nodes, [])
    want = [("focus_flag", "nodes[2]"), ("focus_seed_duplicate", A), ("node_alias_ambiguous", "arxiv:1"), ("node_alias_ambiguous", "doi:10.1/x"), ("node_alias_duplicate", "nodes[0]"), ("node_alias_normalized", "nodes[1]"), ("node_alias_normalized", "nodes[1]"),
            ("node_alias_normalized", "nodes[1]"), ("node_id_duplicate", "nodes[1]"), ("node_id_duplicate", "nodes[2]"), ("node_order", "nodes"), ("node_seed", "nodes[2]"), ("root_resolution", "root")]
    assert got == sorted((1, *w) for w in want)
    blank = faults(spark, [(1, None)], [node(0, "b"), node(1, None), node(2, "a"), node(3, " ", True, "x")], [])
    assert blank == sorted((1, *w) for w in [("node_id", "nodes[1]"), ("node_id", "nodes[3]"), ("focus_seed", "nodes[3]"), ("root_missing", "root"), ("root_focus", "root")])


def test_edge_faults(spark):
    nodes = [node(0, "a", True, A), node(1, "b")]
    edges = [edge(0, "b", "a"), edge(1, "a", "z"), edge(2, "a", "b", "cites"), edge(3, "a", "b", rel="ablation"), edge(4, "a", "b", confidence=1.1), edge(5, "a", "b", "ablation", conf=0.1, rationale=" ")]
    got = faults(spark, [(1, "a")], nodes, edges)
    want = [("edge_order", "edges"), ("edge_endpoint", "edges[1]"), ("edge_relation", "edges[2]"), ("edge_relation_alias", "edges[3]"), ("edge_confidence", "edges[4]"), ("edge_duplicate", "edges[4]"), ("edge_confidence_alias", "edges[5]"), ("edge_rationale", "edges[5]")]
    assert got == sorted((1, *w) for w in want)


@pytest.mark.parametrize("text, codes", [
    (None, ["provenance_shape"]), ("", ["provenance_shape"]), ("[]", ["provenance_shape"]), ("{", ["provenance_shape"]), (provenance(), []),
    (provenance(more=1), ["provenance_fields"]), (provenance(drop=["evidence"]), ["provenance_fields", "provenance_evidence"]), (provenance(classification=3), ["provenance_classification"]),
    (provenance(producer__name=" "), ["provenance_producer"]), (provenance(producer__by="x"), ["provenance_producer_fields"]), (provenance(evidence__sha256="0" * 63), ["provenance_evidence"]), (provenance(evidence__x=1), ["provenance_evidence_fields"]),
    (provenance(classification__x=1, classification__schema_version=""), ["provenance_classification_fields", "classification_schema"]), (provenance(classification__method=None), ["classification_method"]),
    (provenance(classification__method="llm"), ["llm_identity"]), (provenance(classification__method="llm", classification__provider="p", classification__model=" ", classification__prompt_version="1"), ["classification_identity", "llm_identity"]),
    (provenance(classification__method="llm", classification__provider="p", classification__model="m", classification__prompt_version="1"), []),
])
def test_provenance(spark, text, codes):
    assert spark.createDataFrame([(text,)], "p string").select(contracts.provenance_faults(F.col("p"))).first()[0] == codes


def test_structure_and_labels(spark):
    graphs = spark.createDataFrame([(1, 2000, False), (2, 2000, True), (3, 2000, False)], "graph_id long, min_year long, is_theme boolean")
    nodes = spark.createDataFrame([(1, 0, "a", True, 1999, None), (1, 1, "b", False, None, "x"), (1, 2, "c", False, None, "y"), (2, 0, "a", True, 1990, "x"), (3, 0, "e", None, 1990, "q")], "graph_id long, pos long, id string, is_focus boolean, year long, cluster string")
    clusters = spark.createDataFrame([(1, "k"), (3, "k")], "graph_id long, id string")
    denied = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    got = sorted(tuple(r) for r in contracts.structural_faults(graphs, nodes, clusters, denied).collect())
    assert got == [(1, "cluster_dangling", "nodes[1]"), (1, "focus_denied", "nodes[0]"), (1, "focus_too_old", "nodes[0]"), (2, "focus_denied", "nodes[0]"), (3, "no_focus", "nodes")]
    edges = spark.createDataFrame([(1, "a", "b", "extends"), (1, "a", "b", "extends"), (1, "b", "c", "ablation"), (1, "c", "d", "successor"), (2, "a", "b", "extends"), (1, None, "b", "extends")], "graph_id long, src string, dst string, relation string")
    labels = spark.createDataFrame([(1, 0, "a", "b", "extends", "correct"), (1, 1, "a", "b", "extends", "wrong"), (1, 2, "c", "d", "successor", None), (1, 3, "c", "d", "extends", "correct"), (1, 4, None, "d", "extends", "correct")], "graph_id long, pos long, src string, dst string, relation string, verdict string")
    got = sorted(tuple(r) for r in contracts.edge_label_faults(edges, labels).collect())
    assert got == [(1, "edge_label_duplicate", "a->b:extends"), (1, "edge_label_invalid", "labels[2]"), (1, "edge_label_invalid", "labels[4]"), (1, "edge_label_unknown", "c->d:extends"), (1, "edge_unlabelled", "c->d:successor"), (1, "edge_wrong", "a->b:extends"), (2, "edge_unlabelled", "a->b:extends")]
    assert contracts.edge_label_faults(edges.limit(0), labels.limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digest(rows, block, levels):
    level = [sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in rows]
    for _ in range(levels):
        level = [sha("".join(level[k : k + block])) for k in range(0, len(level), block)]
    return level[0]


def test_digests(spark):
    rows = [("a", k, None if k % 7 == 0 else f"é{k}") for k in range(50)] + [("b", 3, ""), ("b", 1, None)]
    df = spark.createDataFrame(rows + [(None, 1, "x")], "g string, k long, text string")
    got = {r["g"]: (r["digest"], r["n_rows"]) for r in snapshots.ordered_digests(df.repartition(5), "g", ["k"], ["k", "text"], block=4, levels=3).collect()}
    own = lambda g: [r[1:] for r in sorted(rows, key=lambda r: r[1]) if r[0] == g]
    assert got == {"a": (plain_digest(own("a"), 4, 3), 50), "b": (plain_digest(own("b"), 4, 3), 2)}
    turned = snapshots.ordered_digests(df.withColumn("k2", -F.col("k")), "g", ["k2"], ["k", "text"], block=4, levels=3).where("g = 'a'").first()
    assert turned["digest"] != got["a"][0]
    with pytest.raises(Exception, match="too many rows"):
        snapshots.ordered_digests(df, "g", ["k"], ["text"], block=4, levels=2).collect()
    assert snapshots.ordered_digests(df.limit(0), "g", ["k"], ["text"]).count() == 0


def test_snapshot_faults(spark):
    row = "snapshot string, pos long, source_id string, paper_id string, url string, title string, abstract string, decision string, authors array<string>"
    rows = spark.createDataFrame([("s", 0, "a", "p:a", "u/a", "T", "x", "oral", ["A"]), ("s", 1, "c", "p:c", "u/c", "T", None, "Odd", ["A"]), ("s", 2, "b", "p:b", "u/b", "U", "", "odd ", ["A"]), ("t", 0, None, None, None, None, None, None, None), ("t", 1, "d", "p:d", "u/d", "x" * 10_001, "x" * 100_001, "oral", [None]), ("lone", 0, "a", "p:a", "u/a", "T", "", "oral", ["A"])], row)
    content = ["source_id", "title", "abstract"]
    digest = {r["snapshot"]: r["digest"] for r in snapshots.ordered_digests(rows, "snapshot", ["pos"], content).collect()}
    head = lambda *r: spark.createDataFrame(r, "snapshot string, duplicate_titles long, unknown array<struct<label:string,n:long>>, fingerprint string")
    run = lambda *r: sorted(tuple(x) for x in snapshots.snapshot_faults(head(*r), rows, F.concat(F.lit("p:"), "source_id"), "u/", ("oral", "poster"), content, most_rows=3).collect())
    told = run(("s", 1, [("odd", 2)], digest["s"]), ("t", 0, [("", 1)], digest["t"]), ("none", 0, None, None))
    want = [("lone", "header_missing", "header"), ("none", "rows", "header"), ("s", "row_order", "rows"), ("t", "authors", ""), ("t", "decision_label", ""), ("t", "row_identity", ""), ("t", "title", ""), ("t", "abstract", "d"), ("t", "author", "d"), ("t", "title", "d")]
    assert told == sorted(want)
    codes = lambda faults: [f[1] for f in faults if f[0] == "s"]
    assert codes(run(("s", 0, [("z", 1), ("a", 1)], "0"))) == ["fingerprint", "row_order", "statistics", "unknown_decisions"]


CATALOG = "conference string, paper_id string, type string, abstract string, authors string"


def seen(spark, root, number=None):
    rows = published.current(spark, root, number)
    return None if rows is None else sorted((r["conference"], r["paper_id"][0], r["abstract"]) for r in rows.collect())


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}/catalog"
    df = lambda *rows: spark.createDataFrame(rows, CATALOG)
    one, two, other = ("x", A, "Oral", "text", "N"), ("x", B, "Poster", "more", "N"), ("007", C, "Poster", None, None)
    assert seen(spark, root) is None and published.publish(df(one, two, other), root) == []
    first = [("007", "c", None), ("x", "a", "text"), ("x", "b", "more")]
    assert seen(spark, root) == first
    assert published.publish(df(one, other), root) == [("x", "fewer_papers", 1), ("x", "lost_ids", 1)]
    assert published.publish(df(one, two), root) == [("007", "dropped", 1)]
    assert published.publish(df(("x", A, "Poster", " ", None), two, other), root) == [("x", "erased_abstract", 1), ("x", "erased_authors", 1), ("x", "fewer_orals", 1)]
    assert published.publish(df(one, one, two, other, ("Bad Name", "zz", "Oral", "", ""), (None, None, None, None, None)), root) == [("", "paper_id", 1), ("", "slug", 1), ("Bad Name", "paper_id", 1), ("Bad Name", "slug", 1), ("x", "duplicate", 1)]
    assert published.publish(df(one, two, other, ("y", A, "Oral", "else", "N")), root) == [("x", "conflicting_abstracts", 1)]
    assert published.publish(df(one, two, other), root, most_papers=1) == [("x", "too_many", 2)]
    assert seen(spark, root) == first and published.head(spark, root) == 1 and len(list((tmp_path / "catalog" / "data").iterdir())) == 1
    assert published.publish(df(one), root, whole=False, allow_shrink=("x",)) == []
    assert seen(spark, root) == [first[0], first[1]] and seen(spark, root, 1) == first
    assert published.publish(df(("y", B, "Oral", "more", "N")), root, whole=False) == []
    assert seen(spark, root) == [first[0], first[1], ("y", "b", "more")] and {r["papers"] for r in published.index(spark, root).collect()} == {1}
    published.rollback(spark, root, 1)
    assert seen(spark, root) == first and published.head(spark, root) == 4


def test_of_two_publishers_one_fails(spark, tmp_path):
    root = f"file://{tmp_path}/race"
    rows = spark.createDataFrame([("x", A, "Oral", "text", "N")], CATALOG)
    assert published.publish(rows, root) == []
    with pytest.raises(Exception, match="(?i)exist"):
        published._commit(spark, root, 1, "other")
    assert seen(spark, root) == [("x", "a", "text")]
    empty = published.publish(rows.limit(0), f"file://{tmp_path}/empty")
    assert empty == [] and published.publish(rows.limit(0), root) == [("x", "dropped", 1)]
