"""The corpus pipeline: documents through toxicity, quality, near-duplicates, decontamination and encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
documents; the last returns token ids. ``run`` writes each stage's rows as Parquet to the shared folder and reads
them again, so a lost executor repeats work of one stage only.

Defined cases, for every stage: a null text is an empty one, and what is empty is neither toxic nor a copy of anything but
other empty texts, holds no benchmark item and has no token ids; documents with a null id stay in the filtering stages
(near-duplicates are told apart by ids, so those without one are never taken for copies); rows that share an id stay or
go together where copies are concerned, and each on its own text elsewhere; an empty table stays empty; further columns,
whatever their names, are kept by all stages but the last, which returns doc_id, n_tokens, ids and round_trip. Without
labels of both classes the toxicity stage uses its seed words, and the quality stage keeps every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, pieces, quality, simhash, toxicity
from lectern.llm.common import table
from lectern.plans.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of toxicity 0.3 or more, by a lexicon fitted to the labelled rows among them."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), below=0.3)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of quality below 0.7, by a classifier fitted to the labelled rows among them."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")), least=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group. Fingerprints propose pairs, and 5-word shingles with a Jaccard
    similarity of 0.8 or more make them links."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold four fifths of a benchmark item's 5-word shingles."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return pieces.encode(docs).select(F.col("id").alias("doc_id"), "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("encoding", encode),
]

#: Fitted scorers, XXH64 fingerprints and the vocabulary's search are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
