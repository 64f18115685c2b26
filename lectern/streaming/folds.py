"""Ordered folds of keyed rows, with memory for one state and one batch whatever a key's number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable[[tuple, tuple], tuple[tuple, object]], keep: list[str], name: str, kind: str) -> DataFrame:
    """The kept columns of each row with what ``step(state, row)`` says of it; keys stream in order of ``order``.

    ``step`` takes the state and the row as a named tuple, and gives the next state and the row's value. A null key is
    a key of its own.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), f"{name} {kind}"])
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), start
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = getattr(row, key)
                own = None if own != own else own
                if own != now:
                    now, state = own, start
                state, value = step(state, row)
                out.append(value)
            yield batch[keep].assign(**{name: out})

    return dealt.mapInPandas(run, schema)
