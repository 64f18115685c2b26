"""Relation guards and topic admission as column rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.storage import spread


def guard(edges: DataFrame, survey: Column, unsupported: Column, most: float = 0.6) -> DataFrame:
    """Edges of surveys and claims without evidence fall to baseline_only with a capped confidence."""
    falls = survey | unsupported
    return edges.withColumns({"confidence": F.when(falls, F.least("confidence", F.lit(most))).otherwise(F.col("confidence")), "relation": F.when(falls, "baseline_only").otherwise(F.col("relation"))})


def seed_weight(role: Column) -> Column:
    return F.when(role == "subject", 1.0).when(role == "component", 0.25).otherwise(0.5)


def admits(role: Column, z: Column) -> Column:
    """Subjects need no more than the mean, components more than others."""
    return z >= F.when(role == "subject", 0.0).when(role == "component", 1.25).otherwise(1.0)


def version_of(title: Column) -> tuple[Column, Column]:
    """(base, version) of titles that end in a version number of up to two digits; version 1 without one."""
    low = F.trim(F.lower(title))
    number = F.regexp_extract(low, r"[\s-]v?([0-9]{1,2})$", 1).try_cast("int")
    return F.when(number.isNull(), low).otherwise(F.regexp_replace(low, r"[\s-]+v?[0-9]{1,2}$", "")), F.coalesce(number, F.lit(1))


def improved_name(title: Column) -> Column:
    """The name that a title says it improves, else empty."""
    return F.regexp_extract(F.trim(F.lower(title)), r"^(?:improved|enhanced|better)\s+(.*)$", 1)


def is_version_increment(parent: Column, child: Column, most: int = 20) -> Column:
    """The child has the parent's base and a larger version, or says that it improves the parent by name."""
    (pb, pv), (cb, cv) = version_of(parent), version_of(child)
    improved = improved_name(child)
    return ((pb == cb) & (cv > pv) & (cv <= most)) | ((improved != "") & (improved == pb))


def version_increments(titles: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """(parent, child) of titles(id, title, *keys): the pairs with the same keys, the parent's id smaller, for which
    ``is_version_increment`` holds. Titles are taken apart once each, and only those that agree meet."""
    base, version = version_of(F.col("title"))
    parts = titles.select("id", *keys, base.alias("base"), version.alias("version"), improved_name(F.col("title")).alias("improved"))
    parent = spread(parts.select(*keys, "base", F.col("id").alias("parent"), F.col("version").alias("_pv")), *keys, "base")
    child = parts.select(*keys, "base", F.col("id").alias("child"), F.col("version").alias("_cv"), "improved")
    larger = (F.col("_cv") > F.col("_pv")) & (F.col("_cv") <= most)
    by_version = parent.join(child, [*keys, "base"]).where((F.col("parent") < F.col("child")) & larger)
    named = child.where("improved <> ''").withColumnsRenamed({"base": "_cb", "improved": "base"})
    by_name = parent.join(named, [*keys, "base"]).where((F.col("parent") < F.col("child")) & ~((F.col("base") == F.col("_cb")) & larger))
    return by_version.select("parent", "child").unionByName(by_name.select("parent", "child"))


def initialism(title: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(title), F.lit("[a-z][a-z0-9]*"), F.lit(0)), lambda w: F.substring(w, 1, 1)), "")


def is_acronym_increment(parent: Column, child: Column, shared_authors: Column, least: int = 2) -> Column:
    """The child is the parent's initials with a version of 2 or more, and they share an author."""
    base, version = version_of(child)
    letters = initialism(parent)
    return (F.char_length(letters) >= least) & (F.regexp_replace(base, "[^a-z]", "") == letters) & (version >= 2) & shared_authors


def evaluate_batches(rows: DataFrame, provider: Callable[[list[str]], list[tuple[int, str]]], text_col: str, size: int = 64) -> DataFrame:
    """Adds relevance and summary from a provider that takes texts in batches; it runs on the executors."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "relevance int, summary string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for at in range(0, len(batch), size) for x in provider(batch[text_col].iloc[at : at + size].tolist())]
            yield batch.assign(relevance=[x[0] for x in found], summary=[x[1] for x in found])

    return rows.mapInPandas(run, schema)


def relabel(edges: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Provisional relations replaced where a second pass has answered; its keys are unique."""
    late = answers.select(*keys, F.col("relation").alias("_late"))
    return edges.join(late, keys, "left").withColumn("relation", F.coalesce("_late", "relation")).drop("_late")


def first_unfinished(jobs: DataFrame, key: str, job: str, done: Column, order: list[str]) -> DataFrame:
    """(key, stage): the first job in a fixed order that is not done; null if all are."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(job))
    return jobs.groupBy(key).agg(F.min_by(F.when(~done, F.col(job)), F.when(~done, place)).alias("stage"))
