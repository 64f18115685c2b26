"""Near copies of the pipeline against exact 5-word Jaccard similarity of all pairs."""

import random

import numpy as np

import corpus_pipeline
from lectern.llm import overlap, pieces, quality, simhash, toxicity
from tests.llm.test_dedup import plain_matches


def plain_set(text):
    w = simhash.words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(rows):
    sets, label = {i: plain_set(t or "") for i, t in rows}, {i: i for i, _ in rows}
    near = {i: [j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    while (new := {i: min(label[j] for j in near[i]) for i in sets}) != label:
        label = new
    return {i for i in sets if label[i] == i}


def test_stage_is_exact_similarity_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == plain_kept(rows)


def test_planted_pairs_around_the_threshold(spark):
    rng, rows = random.Random(5), []
    common = [f"c{k}" for k in range(40)]
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))] + common * rng.randrange(2)
        rows.append((len(rows), " ".join(base)))
        for changes in (1, 2, 3, 4):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "a b"), (len(rows) + 3, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == plain_kept(rows)


def test_passages_that_a_crowd_quotes(spark):
    """More texts than a key tells pairs of share a passage; copies of them differ elsewhere or within it."""
    rng, rows = random.Random(8), []
    passage = [f"p{k}" for k in range(60)]
    for k in range(70):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 20, 120]))]
        text = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.randrange(3)):
            copy = list(text)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(3, rows[3][1]), (5, "another text under an id that is taken by one of the crowd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_row = [(k, t) for k, (_, t) in enumerate(rows)]
    kept = plain_kept(by_row[:-2])
    got = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert got - {5} == kept - {5}


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        a = np.sort(rng.choice(pool, min(n, len(pool)), replace=False))
        b = np.union1d(a[rng.random(len(a)) > 0.1], rng.choice(pool, 1 + n // 20))
        common, counts = pool[::3], rng.integers(1, 9, len(pool[::3]))
        shared = len(np.intersect1d(a, b))
        if 9 * shared >= 4 * (len(a) + len(b)):
            assert len(np.intersect1d(overlap.prefix(a, common, counts), overlap.prefix(b, common, counts)))


def test_pipeline_against_plain_stages_with_exact_similarity(spark):
    sf = "/root/testdata/sf0.001"
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = [tuple(r) for r in frame.select("doc_id", "text").orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [d for d, s in zip(docs, toxicity.fit(frame, labels).scores([t for _, t in docs]), strict=True) if s < 0.3]
    model = quality.fit(frame.where(frame.doc_id.isin([i for i, _ in kept])), labels)
    kept = [d for d, s in zip(kept, model.scores([t for _, t in kept]), strict=True) if s >= 0.7]
    keepers = plain_kept(kept)
    kept = [d for d in kept if d[0] in keepers]
    leaks = {m[0] for m in plain_matches(kept, items)}
    codec = pieces.codec(pieces.DEFAULT_MODEL)
    want = {i: codec.encode(t).tolist() for i, t in kept if i not in leaks}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()} == want
