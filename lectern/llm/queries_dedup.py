"""Registered queries of the deduplication and decontamination operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, simhash
from lectern.llm.common import table


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3, segments=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits("fp0").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, threshold=0.8)
    return found.select(F.col("id").alias("doc_id"), "item_id", "item_shingles", "shared", "containment")


OP4_SQL = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(5, len(w)) AS width, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda p: array_to_string(w[p:p + least(5, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
x AS (SELECT item_id, len(s) AS n, unnest(s) AS sh FROM i),
widths AS (SELECT DISTINCT width FROM i),
y AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - width + 2), lambda p: array_to_string(w[p:p + width - 1], ' '))) AS sh FROM d, widths)
SELECT id AS doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, CAST(count(*) AS INTEGER) AS shared, CAST(count(*) AS DOUBLE) / n AS containment
FROM x JOIN y USING (sh) GROUP BY id, item_id, n HAVING count(*) >= 0.8 * n
"""
