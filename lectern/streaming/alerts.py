"""Alerts of a watchdog: a new set of problems is told at once, a steady one again after an interval, and their end once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.streaming.folds import ordered_fold


def fingerprint(problems: Column) -> Column:
    """Distinct problem keys in order, one a line."""
    return F.array_join(F.array_sort(F.array_distinct(problems)), "\n")


def decide(state: tuple, problems: str, at: float, interval: float) -> tuple[tuple, str]:
    """State is the set told last and when; the interval runs from that alert, not from the last look."""
    told, when = state
    if not problems:
        return (("", 0.0), "resolved") if told else (state, "none")
    if problems != told:
        return (problems, at), "new"
    return ((problems, at), "reminder") if at - when >= interval else (state, "none")


def decisions(looks: DataFrame, interval_hours: float) -> DataFrame:
    """(id, decision) of looks(watch, id, at, problems): each watch's looks in order of time, then id."""
    timed = looks.select("watch", "id", F.col("at").cast("timestamp").cast("double").alias("at"), F.coalesce("problems", F.lit("")).alias("problems"))

    def step(state: tuple, row) -> tuple[tuple, str]:
        return decide(state, row.problems, row.at, interval_hours * 3600)

    return ordered_fold(timed, "watch", ["at", "id"], ("", 0.0), step, ["id"], "decision", "string")
