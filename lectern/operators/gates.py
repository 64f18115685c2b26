"""Set gates: what was lost, gained or changed between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row per key with its number of rows on either side: one shuffle for both versions."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides and on one side only."""
    return _sides(a, b, key).agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("matched"), F.count_if(F.col("b") == 0).alias("only_left"), F.count_if(F.col("a") == 0).alias("only_right"))


def shrink(before: DataFrame, after: DataFrame, key: str, least: float) -> DataFrame:
    """Rows before and after, lost and gained keys, and whether too few rows are left."""
    sums = _sides(before, after, key).agg(F.sum("a").alias("before"), F.sum("b").alias("after"), F.count_if(F.col("b") == 0).alias("lost"), F.count_if(F.col("a") == 0).alias("gained"))
    return sums.withColumn("refused", F.col("after") < F.col("before") * F.lit(least))


def diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, kind): missing, extra or changed values; equal ones (null equals null) are left out."""
    x, y = a.select(F.col(key).alias("k"), F.col(value).alias("x"), F.lit(True).alias("l")), b.select(F.col(key).alias("k"), F.col(value).alias("y"), F.lit(True).alias("r"))
    both = x.join(y, "k", "full_outer").where(F.col("l").isNull() | F.col("r").isNull() | ~F.col("x").eqNullSafe(F.col("y")))
    return both.select(F.col("k").alias(key), F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed").alias("kind"))
