"""Request quotas in order of arrival: site-wide counts by UTC hour and day, and a window of an hour for each key.

The site-wide caps are looked at first and charge nothing; then the key's window, which its first allowed request opens,
is charged; only allowed requests count anywhere. The order of all requests matters, so a day is folded in order of time,
with memory for the keys that have an open window (no more than the hour's cap, twice). What goes from one day to the
next is the windows that are open at midnight: days are folded side by side from what the days before left in the last
round, until that no longer changes, which is after two or three rounds as a rule and exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.storage import materialize

HOUR = 3600.0


@dataclass(frozen=True)
class Caps:
    key_hour: int = 5
    hour: int = 10
    day: int = 40


class Ledger:
    """One day's counts; ``windows`` maps a key to (allowed, end) and begins with what is open at midnight."""

    def __init__(self, caps: Caps, windows: dict) -> None:
        self.caps, self.windows = caps, dict(windows)
        self.day, self.hour, self.in_hour = 0, None, 0

    def take(self, key, at: float) -> str:
        if self.hour != at // HOUR:
            self.hour, self.in_hour = at // HOUR, 0
            self.windows = {k: w for k, w in self.windows.items() if w[1] > at}
        if self.day >= self.caps.day:
            return "global_day"
        if self.in_hour >= self.caps.hour:
            return "global_hour"
        count, end = self.windows.get(key, (0, 0.0))
        if end <= at:
            count, end = 0, at + HOUR
        if count >= self.caps.key_hour:
            return "key"
        self.windows[key] = count + 1, end
        self.day += 1
        self.in_hour += 1
        return "ok"

    def left(self, midnight: float) -> dict:
        return {k: w for k, w in self.windows.items() if w[1] > midnight}


def _folded(ordered: DataFrame, caps: Caps, open_at: dict, keep: str) -> DataFrame:
    """Verdicts, or each day's open windows at its end (day, key, allowed, until)."""
    verdicts = keep == "verdicts"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ledger = None, None

        def end() -> pd.DataFrame:
            rows = [(now, k, *w) for k, w in ledger.left((now + 1) * 86400.0).items()]
            return pd.DataFrame(rows, columns=["day", "key", "allowed", "until"])

        for batch in batches:
            out = []
            for day, key, at in zip(batch["day"], batch["key"], batch["at"], strict=True):
                if day != now:
                    if ledger and not verdicts:
                        yield end()
                    now, ledger = day, Ledger(caps, open_at.get(day, {}))
                out.append(ledger.take(key, at))
            if verdicts:
                yield pd.DataFrame({"id": batch["id"], "verdict": out})
        if ledger and not verdicts:
            yield end()

    return ordered.mapInPandas(run, "id long, verdict string" if verdicts else "day long, key string, allowed long, until double")


def consume(requests: DataFrame, caps: Caps = Caps(), most: int = 400) -> DataFrame:
    """(id, verdict) of requests(id, key, at): ok, or by what it was refused (global_day, global_hour, key)."""
    at = F.col("at").cast("timestamp").cast("double")
    timed = materialize(requests.select("id", F.col("key").cast("string").alias("key"), at.alias("at"), F.floor(at / 86400).alias("day")), "quota")
    ordered = timed.repartition("day").sortWithinPartitions("day", "at", "id")
    open_at: dict = {}
    for _ in range(most):
        found: dict = {}
        for r in _folded(ordered, caps, open_at, "windows").collect():  # at most caps.hour rows for each day and hour before midnight
            found.setdefault(r["day"] + 1, {})[r["key"]] = r["allowed"], r["until"]
        if found == open_at:
            return _folded(ordered, caps, open_at, "verdicts")
        open_at = found
    raise RuntimeError(f"windows did not settle in {most} rounds")
