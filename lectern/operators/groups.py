"""Folds over many small groups: rows stream through a task in order of their group, without a call or a frame a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.plans.storage import spread

_ROWS = 10_000


def in_groups(rows: DataFrame, work: Callable[[list[tuple]], Iterable[tuple]], like: DataFrame) -> DataFrame:
    """What ``work`` makes of each group's rows, in any order; the group is the first column, and the result has the columns of
    the empty frame ``like``. A task holds one group at a time."""
    key = rows.columns[0]
    schema = to_arrow_schema(like.schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(every, key=itemgetter(0)):
            yield from work(list(group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for row in told(batches):
            out.append(row)
            if len(out) >= _ROWS:
                yield made()
                out.clear()
        if out:
            yield made()

    return spread(rows, key).sortWithinPartitions(key).mapInArrow(run, like.schema)
