"""Dense ordinals without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.storage import materialize

_LOCAL = (1 << 33) - 1  # the part of Spark's increasing ids that counts within a partition


def sorted_ordinal(df: DataFrame, order: list[str]) -> DataFrame:
    """0..n-1 in the given order: rows are dealt by ranges, numbered within each, and offset by the ranges before.

    Ranges follow a sample of the rows, so any distribution is dealt evenly. The window holds one row a range.
    """
    ordered = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ordinals")
    placed = ordered.select(*df.columns, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit(_LOCAL)).alias("_i"))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_p").select(*df.columns, (F.col("_before") + F.col("_i")).alias("ordinal"))


def dense_ordinal(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """0..n-1 in (group, order)."""
    return sorted_ordinal(df, [group, *order])
