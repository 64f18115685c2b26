"""Embedding relevance: centroid of seeds and z scores over a pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centroid(vectors: DataFrame, column: str) -> DataFrame:
    """One row with the mean vector, averaged by position with partial sums."""
    means = vectors.select(F.posexplode(F.col(column))).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def z_scores(scored: DataFrame, column: str) -> DataFrame:
    """Adds z by the population deviation; 0 where the pool has one row or no spread."""
    stats = scored.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_sd"), F.count(column).alias("_n"))
    z = F.when((F.col("_n") >= 2) & (F.col("_sd") > 1e-9), (F.col(column) - F.col("_m")) / F.col("_sd")).otherwise(0.0)
    return scored.crossJoin(F.broadcast(stats)).withColumn("z", z).drop("_m", "_sd", "_n")
