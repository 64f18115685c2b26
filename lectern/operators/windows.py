"""First-wins, top-k and lookup patterns shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def mode(df: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """The commonest value of each key with at least ``least`` known values; ties take the smallest value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    best = counted.withColumn("known", F.sum("n").over(whole)).where(F.col("known") >= least)
    return first_by(best, keys, [F.desc("n"), F.asc(value)])


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on keys that are unique on both sides."""
    def single(df: DataFrame) -> DataFrame:
        return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")

    return single(left).join(single(right), key)


def page(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """A page of rows, numbers from 1; below 1 is the first page."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
