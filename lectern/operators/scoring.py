"""Rule filter, weighted score and ranking of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(papers: DataFrame, seen: DataFrame, key: str = "uid") -> DataFrame:
    return papers.join(seen.select(key), key, "left_anti")


def fresh_seen(seen: DataFrame, now: Column, max_days: int, at: str = "seen_at") -> DataFrame:
    """Entries newer than the limit; unreadable times go."""
    return seen.where(F.try_to_timestamp(F.col(at).cast("string")) > now - F.make_dt_interval(F.lit(max_days)))


def rule_filter(papers: DataFrame, categories: list[str], since: str, excluded: list[str], seen: DataFrame | None = None) -> DataFrame:
    """A category of the list (or none given at all), recent, without excluded substrings, unseen."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    kept = papers.where(F.col("category").isNull() | F.col("category").isin(categories)).where(F.col("published_date") >= since)
    for word in excluded:
        kept = kept.where(~F.contains(text, F.lit(word.lower())))
    return kept if seen is None else unseen(kept, seen)


def weighted(weights: dict[str, float]) -> Column:
    """Sum of score columns by weight; a missing score counts 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * F.lit(weight)
    return total


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n in a total order; 0 means all."""
    return df.orderBy(*order).limit(n) if n else df.orderBy(*order)
