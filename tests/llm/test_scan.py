"""Sharding, nearest neighbours and licence scans."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import licences, maglev, registry, vptree


def test_lookup_table_is_even_and_stable():
    names = [f"s{k}" for k in range(10)]
    table = maglev.lookup_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = maglev.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved / 1009 < 0.2
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            maglev.lookup_table(bad, 101)
    with pytest.raises(ValueError):
        maglev.lookup_table(["a"], 100)


def test_placement(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "key string, slot int")
    got = maglev.place(rows, "key", ["x", "y", "z"], 101).collect()
    assert len(got) == 4 and len({r["shard"] for r in got if r["key"] == "a"}) == 1
    assert maglev.place(rows.limit(0), "key", ["x"], 101).count() == 0


def plain_nearest(points, ids, asked, k):
    out = {}
    for q in asked:
        d = np.sqrt(((points - points[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((float(x), i) for x, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def test_factor_one_is_exact_and_larger_factors_keep_recall(spark):
    rng = np.random.default_rng(3)
    points = np.r_[rng.normal(size=(600, 8)), np.repeat(rng.normal(size=(1, 8)), 300, 0)]
    ids = list(range(900))
    rows = [(i, p.tolist(), 0) for i, p in zip(ids, points, strict=True)]
    bad = [(900, None, 0), (1000, [0.0] * 8, 0), (1100, [float("nan")] * 8, 0), (1200, [1.0, None], 0), (1300, [1.0, 2.0], 0), (0, points[0].tolist(), 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, score int")
    asked = [i for i in ids if i % 100 == 0]
    want = plain_nearest(points, ids, asked, 10)
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        got = {}
        for r in vptree.nearest(df, F.col("vec_id") % 100 == 0, k=10, factor=factor, shard_rows=200, block_rows=4).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["score"], r["id"]))
        hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in asked) / (10 * len(asked))
        assert hits >= least
        if factor == 1.0:
            assert {q: [i for _, i in x] for q, x in got.items() if q in want} == {q: [i for _, i in x] for q, x in want.items()}
            assert all(abs(a - b) < 1e-12 for q in asked for (a, _), (b, _) in zip(want[q], got[q], strict=True))
            assert 1300 not in got and set(got) == set(asked)
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_licence_places(spark):
    rows = [
        (1, "Released under the MIT License. Under the MIT license"), (2, "Apache License, Version 2.0; CC-BY-NC cc by nc"), (3, None), (4, "mit der apache"), (4, "mit der apache"),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "license version 2 under"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = {r["id"]: r for r in licences.report(licences.scan(df)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 5, "mit")
    assert (got[2]["n_base"], got[2]["base_labels"]) == (3, "apache-2,cc-by-nc")
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["labels"], got[3]["score"]) == (0, 0, None, "", 0.0)
    assert got[4]["labels"] == got[7]["labels"] == "" and got[5]["labels"] == "mit" and got[5]["base_labels"] == "" and got[6]["labels"] == "gpl-3" and got[6]["score"] == 1.0
    assert licences.report(licences.scan(df.limit(0))).count() == 0
    long = spark.createDataFrame([(1, "filler words " * 200_000 + "under the MIT license"), (2, "cc cc by by nc cc by nc nc"), (3, "cc by n\u212a nc")], "doc_id long, text string")
    got = {r["id"]: (r["n_words"], r["n_base"], r["first_word"], r["labels"]) for r in licences.report(licences.scan(long)).collect()}
    assert got == {1: (400_004, 1, 400_000, "mit"), 2: (9, 1, 5, "cc-by-nc"), 3: (4, 0, None, "")}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    from tests.oracle import differences

    assert differences(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001") == []


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        assert kept.join(docs, docs.columns, "left_anti").count() == 0
        docs = kept.cache()
    want = {r["doc_id"] for r in docs.collect()}
    out = pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == want and all(r["round_trip"] for r in out)
