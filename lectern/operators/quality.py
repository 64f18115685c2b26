"""Quality checks: violation counts, tiers, precision and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(kind, violations): rows that break each check."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("violations")).select(F.lit(kind).alias("kind"), "violations") for kind, df in checks.items()))


def tiers(rows: DataFrame, key: str, checks: dict[str, Column], golden: str) -> DataFrame:
    """Checks passed per key, and blocked, unaudited or audited: all but the golden check must hold."""
    found = rows.groupBy(key).agg(*(c.alias(name) for name, c in checks.items()))
    needed = reduce(lambda a, b: a & b, (F.col(name) for name in checks if name != golden))
    passed = reduce(lambda a, b: a + b, (F.col(name).cast("long") for name in checks))
    return found.select(key, passed.alias("passed"), F.when(~needed, "blocked").when(F.col(golden), "audited").otherwise("unaudited").alias("tier"))


def precision_recall(rows: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    counts = rows.agg(F.count_if(predicted & gold).alias("tp"), F.count_if(predicted & ~gold).alias("fp"), F.count_if(~predicted & gold).alias("fn"))
    return counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def leave_one_out_threshold(rows: DataFrame, grid: list[float]) -> DataFrame:
    """(held, threshold, f1): for each fold the threshold of best F1 on the other folds, ties to the larger.

    Counts per fold and threshold come first; the folds are few, so leaving one out is a difference of sums.
    """
    points = rows.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    by = points.groupBy("fold", "t").agg(F.count_if(F.col("gold") & (F.col("score") >= F.col("t"))).alias("tp"), F.count_if(~F.col("gold") & (F.col("score") >= F.col("t"))).alias("fp"), F.count_if(F.col("gold") & (F.col("score") < F.col("t"))).alias("fn"))
    whole = by.groupBy("t").agg(*(F.sum(c).alias(f"_{c}") for c in ("tp", "fp", "fn")))
    rest = by.join(whole, "t").select(F.col("fold").alias("held"), "t", *((F.col(f"_{c}") - F.col(c)).alias(c) for c in ("tp", "fp", "fn")))
    f1 = F.lit(2.0) * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return rest.groupBy("held").agg(F.max(F.struct(f1.alias("f1"), F.col("t").alias("threshold"))).alias("b")).select("held", "b.threshold", "b.f1")


def schema_issues(rows: DataFrame, key: str, rules: list[tuple]) -> DataFrame:
    """(key, issues) of rows that break rules (path, kind, …): required, min, max, in a closed set, or matching a pattern.
    A missing value breaks ``required`` only."""
    def broken(path: str, kind: str, *given) -> tuple[Column, str]:
        c = F.col(path)
        return {
            "required": lambda: (c.isNull(), f"{path}: required"),
            "min": lambda: (c < given[0], f"{path}: below {given[0]}"),
            "max": lambda: (c > given[0], f"{path}: above {given[0]}"),
            "in": lambda: (~c.isin(given[0]), f"{path}: not listed"),
            "pattern": lambda: (~F.regexp(c, F.lit(given[0])), f"{path}: no match"),
        }[kind]()

    issues = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in (broken(*rule) for rule in rules))))
    return rows.select(key, issues.alias("issues")).where("size(issues) > 0")
