"""Inverted indexes of texts, made where a text lies: no word is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_ROWS = 200  # texts whose indexes a task holds at once


def _index(text: str) -> list[tuple[str, list[int]]]:
    places: dict[str, list[int]] = {}
    for at, word in enumerate(text.split(" ")):
        places.setdefault(word, []).append(at)
    return list(places.items())


def inverted_indexes(texts: DataFrame) -> DataFrame:
    """(id, index) of texts(id, text): a map from word to its places, of words between single blanks; null texts have none."""
    (key, kind), kinds = texts.dtypes[0], pa.map_(pa.string(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                ids, words = batch.slice(at, _ROWS).columns
                made = pa.array([None if t is None else _index(t) for t in words.to_pylist()], kinds)
                yield pa.RecordBatch.from_arrays([ids, made], names=[key, "index"])

    return texts.mapInArrow(run, f"{key} {kind}, index map<string, array<int>>")
