"""Evidence rules and catalog operators on rows that tell the cases apart."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import evidence
from lectern.operators import catalog
from lectern.operators.quality import schema_issues
from lectern.sources import landed

STRINGS = "array<string>"


def told(spark, column, **values):
    made = (F.array(*map(F.lit, v)).cast(STRINGS).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in values.items())
    return spark.range(1).select(*made).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("sentences", "relation"), [
    (["We extend [3], outperforming the baseline."], "supersedes"), (["Background.", "Unlike [3] we train."], "contrasts"), (["Our model is based on X."], "extends"), (["It is based on X."], None),
    (["See the ablation study."], "ablation"), (["Compared with X."], "baseline_only"), (["In subsequent work, X."], "successor"), (["following the work of X"], "extends"), (["It serves as a baseline."], "baseline_only"), ([], None), (["  "], None),
])
def test_context_relation(spark, sentences, relation):
    found = told(spark, evidence.context_relation(F.col("c")), c=sentences)
    assert (found and found["relation"]) == relation


def pair(spark, contexts=(), intents=(), influential=False, shared=False, found=True):
    r = told(spark, evidence.pair_relation(F.col("f"), F.col("c"), F.col("i"), F.col("n"), F.col("s")), f=found, c=list(contexts), i=list(intents), n=influential, s=shared)
    return r["relation"], r["rule"]


def test_pair_rules_in_order(spark):
    assert pair(spark, found=False) == ("cites_unspecified", "pair_missing")
    assert pair(spark, ["Unlike [1], ours", "We build on [2]"]) == ("builds_on", "phrase_build")
    assert pair(spark, ["in contrast to X, better than Y"]) == ("compares_with", "phrase_contrast")
    assert pair(spark, ["it is better than Y"]) == ("compares_with", "phrase_compare") and pair(spark, ["We use the X dataset"]) == ("uses_resource", "phrase_resource")
    assert pair(spark, ["x"], ["Result", "methodology"]) == ("builds_on", "intent_methodology") and pair(spark, ["x"], ["result"]) == ("compares_with", "intent_result")
    assert pair(spark, ["x"], influential=True, shared=True) == ("builds_on", "influential") and pair(spark, shared=True) == ("builds_on", "shared_authors")
    assert pair(spark, ["x"], ["background"]) == ("background", "intent_background") and pair(spark, ["x"]) == ("background", "context_no_cue") and pair(spark) == ("cites_unspecified", "no_context")


@pytest.mark.parametrize("sentence", ["We further modify X.", "We use the first encoder of X.", "By following [3] we go on.", "We follow Kipf et al in this.", "This is a generalisation of X.", "Our model is based on X.", "We reuse X."])
def test_build_cues(spark, sentence):
    assert pair(spark, [sentence]) == ("builds_on", "phrase_build")


def test_strict_rules(spark):
    def strict(contexts, intents=(), influential=False, title="Nets"):
        return told(spark, evidence.pair_relation_strict(F.lit(True), F.col("c"), F.col("i"), F.col("n"), F.col("t")), c=list(contexts), i=list(intents), n=influential, t=title)["rule"]

    assert strict(["We build on X"], title="A survey of nets") == "survey" and strict(["X outperforms Y"]) == "context_no_cue" and strict(["Our model outperforms Y"]) == "first_person_compare"
    assert strict(["We trained on the big X corpus."]) == "clause_resource" and strict(["We used X. The corpus is big."]) == "context_no_cue" and strict(["The benchmark of X was used."]) == "clause_resource"
    assert strict(["X 1.2 3.4 5.6 7.8 9.0 end"]) == "table_row" and strict(["x"], ["methodology"]) == "context_no_cue" and strict(["x"], ["methodology"], True) == "intent_influential"


def test_cue_targets_and_quotes(spark):
    def names(sentence, marker=54):
        return told(spark, evidence.cue_names(F.col("s"), F.col("n"), F.lit(marker), [r"inspired\s+by", r"based\s+on"]), s=sentence, n=["MoNet"])

    assert names("Our approach is inspired by [54] who proposed it, with tools of [26].") and not names("In [54] we used layers based on the Graclus method [16].")
    assert names("This is based on MoNet.") and not names("MoNet is good; this is based on the rest.") and not names("We cite [54].")
    quote = told(spark, evidence.picked_quote(F.col("c"), F.col("n"), F.lit(7)), c=["Others [1], [2].", "As in [7], [8].", "Shown in [7].", "MoNet [7] and more [8] [9]."], n=["MoNet"])
    assert quote == "MoNet [7] and more [8] [9]." and told(spark, evidence.picked_quote(F.col("c"), F.col("n"), F.lit(7)), c=["Others [1]."], n=["MoNet"]) is None


def test_catalog_operators(spark):
    before = spark.createDataFrame([(1, "O", "a"), (2, "P", "b"), (3, "P", "c")], "id long, kind string, content string")
    gate = catalog.catalog_gate(before, before.where("id < 3"), "id", F.col("kind") == "O", 0.5).first()
    assert gate["lost"] == 1 and gate["refused"] and not catalog.catalog_gate(before, before, "id", F.col("kind") == "O", 0.9).first()["refused"]
    cache = spark.createDataFrame([(1, 2, "said"), (1, 9, "said"), (2, 1, "template 5"), (2, 1, None)], "src long, dst long, rationale string")
    live = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert sorted((r[0], r[1], r[2]) for r in catalog.purged(catalog.compacted(cache, live), ["^template [0-9]+$"]).collect() if r[2]) == [(1, 2, "said")] and catalog.purged(catalog.compacted(cache, live), ["^template"]).count() == 2
    tiers = lambda rows: spark.createDataFrame(rows, "k long, tier string, nodes long")
    found = dict(catalog.regressions(tiers([(1, "a", 10), (2, "a", 10), (3, "a", 10), (4, "a", 10)]), tiers([(1, "b", 10), (2, "a", 4), (4, "a", 5)]), "k", ["a", "b"]).collect())
    assert found == {1: "tier", 2: "nodes", 3: "gone"}
    edges = spark.createDataFrame([(1, k, 5, 2000, 2001, "template one", None) for k in range(8)] + [(1, k, 6, 2005, 2001, "short", True) for k in range(9)] + [(1, 1, 7, None, 2001, None, False)], "g long, src long, dst long, src_year long, dst_year long, rationale string, evidence boolean")
    m = catalog.edge_metrics(edges, "g", ["template one"]).first()
    assert (m["edges"], m["template"], m["short"], m["reversals"], m["sinks"]) == (18, 8, 9, 9, 1)


def test_schema_issues_and_readers(spark):
    rows = spark.createDataFrame([(1, None, 5.0, "a"), (2, 7, 0.0, "z"), (3, 7, 5.0, None)], "id long, k int, v double, t string")
    found = {r["id"]: r["issues"] for r in schema_issues(rows, "id", [("k", "required"), ("v", "min", 1), ("t", "in", ["a"]), ("t", "pattern", "^[a-y]$")]).collect()}
    assert found == {1: ["k: required"], 2: ["v: below 1", "t: not listed", "t: no match"]}
    assert told(spark, landed.flipped_names(F.col("c")), c="Lee, Ann and Yu, Bo; Plain Name") == ["Ann Lee", "Bo Yu", "Plain Name"]
    pages = spark.createDataFrame([(1, '<a href="x">One</a><a href="x">Again</a><a href="">No</a><a href="y">Two</a>')], "page long, html string")
    assert sorted((r["path"], r["title"]) for r in landed.listing_rows(pages, '<a href="[^"]*">[^<]*</a>', {"path": '"([^"]*)"', "title": ">([^<]*)<"}, key="path").collect()) == [("x", "One"), ("y", "Two")]
