"""Readiness of an edition from probes: one reducer, folded over a table or kept as streaming state.

A probe of a listing is unavailable, failed or a snapshot of items. Unavailable and partial (fewer items than the floor)
forget the listing that was settling; a failure changes nothing but the record of the last probe. A listing not seen
just before is stabilizing; the same listing again, between ``low`` and ``high`` hours after it last counted, is ready;
sooner changes nothing, later starts the count again. Publishing a ready edition keeps its listing, count and items:
from then on fewer items, or one of them missing, is an anomaly, and other bad probes leave it published. A probe older
than the last one is late and changes nothing; the same probe again is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.streaming.folds import ordered_fold

OUT = "edition long, event_id long, state string"
STATE = "last double, event_id long, phase string, listing string, counted double, items string, published string, published_items string"


class Phase(NamedTuple):
    """items are ids, one a line, in order; an edition's list is bounded by its size."""

    last: float = -1.0
    event_id: int = -1
    phase: str = "unavailable"
    listing: str = ""
    counted: float = 0.0
    items: str = ""
    published: str = ""
    published_items: str = ""


EMPTY = Phase()


@dataclass(frozen=True)
class Limits:
    floor: int = 10
    low: float = 6.0
    high: float = 240.0
    ceiling: int | None = None


def reduce(state: tuple, probe: tuple, limits: Limits) -> tuple[tuple, str]:
    """The next state and the probe's verdict; a probe is (hours, event id, kind, listing, items), its kind one of
    snapshot, unavailable, failed and publish."""
    s = Phase(*state)
    at, number, kind, listing, items = probe
    if number == s.event_id and at == s.last:
        return s, "repeat"
    if at < s.last:
        return s, "late"
    s = s._replace(last=at, event_id=number)
    live = bool(s.published)
    forgotten = {} if live and s.phase == "published" else {"listing": "", "counted": 0.0}
    if kind == "failed":
        return s, "failed"
    if kind == "publish":
        if s.phase != "ready":
            return s, "refused"
        return s._replace(phase="published", published=s.listing, published_items=s.items), "published"
    if kind == "unavailable":
        phase = "published" if s.phase == "published" else "unavailable"
        return s._replace(phase=phase, **forgotten), phase
    found = set(items.split("\n")) if items else set()
    if live and s.published_items:
        kept = set(s.published_items.split("\n"))
        if len(found) < len(kept) or not kept <= found:
            return s._replace(phase="anomaly", listing="", counted=0.0), "anomaly"
    if len(found) < limits.floor:
        phase = "published" if s.phase == "published" else "partial"
        return s._replace(phase=phase, **forgotten), phase
    if limits.ceiling is not None and len(found) > limits.ceiling:
        return s._replace(phase="anomaly", listing="", counted=0.0), "anomaly"
    if live and listing == s.published:
        return s._replace(phase="published"), "published"
    if listing != s.listing:
        return s._replace(phase="stabilizing", listing=listing, counted=at, items=items), "stabilizing"
    if s.phase == "ready":
        return s, "ready"
    if at - s.counted < limits.low:
        phase = "published" if s.phase == "published" else "stabilizing"
        return s._replace(phase=phase), phase
    if at - s.counted > limits.high:
        return s._replace(phase="stabilizing", counted=at), "stabilizing"
    return s._replace(phase="ready", counted=at, items=items), "ready"


def _probe(row) -> tuple:
    return row.hours, row.event_id, row.kind, row.listing, row.items_


def verdicts(probes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """probes(edition, event_id, hours, kind, listing, items_), each edition in order of time."""

    def step(state: tuple, row) -> tuple[tuple, str]:
        return reduce(state, _probe(row), limits)

    return ordered_fold(probes, "edition", ["hours", "event_id"], EMPTY, step, ["edition", "event_id"], "state", "string")


def streamed(probes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same over a stream; state goes on from batch to batch."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get if state.exists else tuple(EMPTY), []
        for r in pd.concat(list(parts)).sort_values(["hours", "event_id"]).itertuples():
            now, verdict = reduce(now, _probe(r), limits)
            out.append((r.edition, r.event_id, verdict))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["edition", "event_id", "state"])

    return probes.groupBy("edition").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
