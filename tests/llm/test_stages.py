"""The pipeline's stages on nulls, empty texts, repeats, ties, clashing columns and empty tables; scorers against plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lectern.llm import quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def odd_rows(spark):
    some = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()]
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [*some, (None, some[0][1]), (None, None), (9001, None), (9002, ""), (9003, " \n"), (9004, some[5][1]), (9004, some[5][1]), (9005, long), (9006, long + " end"), (9007, "the same few words stand here twice"), (9008, "The same few words stand here  twice")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("x").alias("id"), F.lit(1).alias("score"), F.lit(2).alias("component"), F.lit("y").alias("ids"))


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    stage, docs = dict(pipeline.STAGES)[name], odd_rows(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "encoding":
        assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and len(rows) == docs.count() and all(r["round_trip"] for r in rows)
        assert {r["n_tokens"] for r in rows if r["doc_id"] in (9001, 9002)} == {0}
    else:
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        ids = [r["doc_id"] for r in rows]
        if name == "near_duplicates":
            assert ids.count(None) == 2 and 9006 not in ids and 9008 not in ids and {9005, 9007, 9001} <= set(ids) and 9002 not in ids and ids.count(9004) in (0, 2)
        if name in ("toxicity", "decontamination"):
            assert {9001, 9002, 9003, 9005} <= set(ids)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_without_labels_nothing_is_lost(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_rows(spark)
    assert pipeline.drop_low_quality(spark, docs, str(tmp_path)).count() == docs.count()
    one = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, one)
    assert not model.fitted and quality.keep(docs, model).count() == docs.count()


def test_quality_scores_against_a_plain_scorer(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    assert model.fitted
    got = {r["id"]: r["score"] for r in quality.score(docs, model).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        tokens = [t for t in quality._TOKEN.findall(text or "")]
        shapes = []
        for k, t in enumerate(tokens):
            shape = t if not (t[0].isalnum() or t[0] == "_") else "0" if t.isdigit() else "X" if t.isupper() and len(t) > 1 else "Xx" if t[0].isupper() else "x"
            shapes.append("=" if k and tokens[k - 1] == t else shape)
        found = set((text or "").lower().split()) | {f"2 {shapes[k]} {shapes[k + 1]}" for k in range(len(shapes) - 1)} | {f"3 {shapes[k]} {shapes[k + 1]} {shapes[k + 2]}" for k in range(len(shapes) - 2)}
        known = [model.known[f] for f in found if f in model.known]
        norm = math.sqrt(sum(r for _, r in known))
        margin = (sum(w for w, _ in known) / norm if norm else 0.0) + model.constant
        assert abs(got[doc] - 1 / (1 + math.exp(-max(-500, min(500, model.a * margin + model.b))))) < 1e-9


def test_toxicity_scores_against_plain_substring_search(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    got = {r["id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        words = toxicity.folded_words(text or "")
        line = f" {' '.join(words)} " if words else ""
        spared = [(at, at + len(p) + 1) for p in lexicon.exceptions for at in range(len(line)) if line.startswith(f" {p} ", at)]
        heaviest = {}
        for at in range(len(line)):
            best = max((w for e, w in lexicon.weights.items() if line.startswith(e, at)), default=0.0)
            if best > 0 and not any(a <= at < b for a, b in spared):
                heaviest[at] = best
        total = math.fsum(heaviest.values())
        a, b, c = lexicon.coefficients
        z = a * math.log1p(total) + b * math.log1p(100 * total / (len(words) + 50)) + c if words else c
        assert abs(got[doc] - 1 / (1 + math.exp(-z))) < 1e-9


def test_folds_of_hidden_letters():
    lexicon = toxicity.Lexicon({" idiot ": 6.0, " utter fool ": 4.0})
    hit = lexicon.features("an idiot")[0]
    for text in ("an ïdiot", "an i​di­ot", "an i.d.i.o.t", "an i d i o t", "an id1ot", "an 1diot", "an idi0t!"):
        assert lexicon.features(text)[0] == hit, text
    assert toxicity.folded_words("call 50 or 110 now") == ["call", "50", "or", "110", "now"]
    assert lexicon.features("an utter fool")[0] > 0 and lexicon.features("a fool, utter")[0] == 0


def test_very_long_texts(spark):
    long = "The quick brown fox, number 7! " * 60_000
    docs = spark.createDataFrame([(1, long), (2, long + "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert all(0 <= r["score"] <= 1 for r in module.score(docs, module.fit(docs, labels)).collect())
    assert len({r["component"] for r in simhash.near_duplicates(docs).collect()}) == 1
    assert np.isfinite(simhash.fingerprint(long)[0])
