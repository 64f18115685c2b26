"""Benchmark decontamination: test items found inside documents of any length.

An item is contained in a document if at least ``threshold`` of the item's distinct word shingles occur in it.
Words are runs of letters and digits (any character beyond ASCII counts as a letter) of the lower-cased text;
shingles are ``width`` words, or the whole item if it is shorter.

Search: items are partitioned by shingle count into powers of two. A partition fixes the length of its items'
bottom-k MinHash sketch, so long that an item which keeps ``threshold`` of its shingles must keep one of the sketch
(it can lose only ``q - ceil(threshold * q)`` of q), and the fewest shingles of a document that may hold its items.
The Jaccard similarity of a short item and a long document tends to zero, so signatures of whole documents can't
be banded; looking up a document's shingle hashes among the sketches keeps every match. Candidates are verified by
exact containment of the shingles themselves.

Items go to the tasks in blocks of at most ``block_bytes`` of text; each block scans the documents once.

Defined cases: null texts are empty; empty texts and items match nothing; null ids are kept as they are; repeated
rows give one result row each; further columns are ignored by ``contained_items``, and kept by ``without_leaks``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import texts

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CHUNK = 1 << 20  # bytes of text hashed at once
_P = 0x9E3779B97F4A7C15 | 1


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(text: str, width: int) -> list[tuple[str, ...]]:
    """Distinct shingles in order; a shorter text is one shingle, a text without words has none."""
    w = words(text)
    if not w:
        return []
    width = min(width, len(w))
    return list(dict.fromkeys(zip(*(w[k:] for k in range(width)), strict=False)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleHasher:
    """64-bit hashes of all shingles of many texts at once, by array operations over their UTF-8 bytes."""

    def __init__(self) -> None:
        inside = np.zeros(256, dtype=bool)
        inside[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
        self.inside = inside
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = pow(_P, -1, 1 << 64)
            self.powers, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, dtype=np.uint64)]) for x in (np.uint64(_P), np.uint64(inverse)))

    def words(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of each word."""
        parts = [t.lower().encode("utf-8", "replace") for t in batch]
        data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts])
        self._grow(len(data) + 1)
        flags = np.r_[False, self.inside[data], False]
        first, last = np.flatnonzero(~flags[:-1] & flags[1:]), np.flatnonzero(flags[:-1] & ~flags[1:])
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])]
        return _mixed((sums[last] - sums[first]) * self.inverse[first]), np.searchsorted(ends, first, side="right")

    def shingles(self, hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of each run of ``width`` words of one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return hashes[:0], owner[:0]
        total = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            total = total * np.uint64(_P) + hashes[k : n + k]
        whole = owner[:n] == owner[width - 1 :]
        return _mixed(total)[whole], owner[:n][whole]


class ItemSketches:
    """Bottom-k sketches of a block of items, looked up by shingle hash."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float) -> None:
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.shingles = [shingles(t, width) for _, t in items]
        hasher = ShingleHasher()
        found: dict[int, list[tuple[int, int, int]]] = {}
        for at, own in enumerate(self.shingles):
            if not own:
                continue
            part = len(own).bit_length() - 1
            largest, least = 2 ** (part + 1) - 1, math.ceil(threshold * 2**part - 1e-9)
            k = largest - math.ceil(threshold * largest - 1e-9) + 1
            h, owner = hasher.words([" ".join(s) for s in own])
            values = np.unique(hasher.shingles(h, owner, len(own[0]))[0])[:k]
            found.setdefault(len(own[0]), []).extend((int(v), at, least) for v in values)
        self.tables = {}
        for w, rows in found.items():
            rows.sort()
            self.tables[w] = tuple(np.array([r[i] for r in rows], dtype=d) for i, d in enumerate((np.uint64, np.int64, np.int64)))

    def candidates(self, batch: list[str], hasher: ShingleHasher) -> set[tuple[int, int]]:
        """(text number, item number) of texts that hold one value of the item's sketch."""
        out: set[tuple[int, int]] = set()
        h, owner = hasher.words(batch)
        for width, (values, item, least) in self.tables.items():
            s, text = hasher.shingles(h, owner, width)
            size = np.bincount(text, minlength=len(batch))
            left, right = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            for at in np.flatnonzero(right > left):
                out.update((int(text[at]), int(i)) for i, n in zip(item[left[at] : right[at]], least[left[at] : right[at]], strict=True) if size[text[at]] >= n)
        return out

    def matches(self, batch: list[str], hasher: ShingleHasher) -> list[tuple[int, int, int, int]]:
        """(text number, item number, the item's shingles, shared shingles), verified."""
        out, seen = [], {}
        for at, item in sorted(self.candidates(batch, hasher)):
            own = self.shingles[item]
            key = at, len(own[0])
            if key not in seen:
                w = words(batch[at])
                seen = {key: set(zip(*(w[k:] for k in range(key[1])), strict=False))} | {k: v for k, v in seen.items() if k[0] == at}
            shared = sum(s in seen[key] for s in own)
            if shared >= math.ceil(self.threshold * len(own) - 1e-9):
                out.append((at, item, len(own), shared))
        return out


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about _CHUNK bytes; null texts are empty."""
    first, held, size = 0, [], 0
    for at in range(batch.num_rows):
        text = batch.column(column)[at].as_py() or ""
        held.append(text)
        size += len(text)
        if size >= _CHUNK:
            yield first, held
            first, held, size = at + 1, [], 0
    if held:
        yield first, held


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks that hold about ``block_bytes`` of text."""
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, item_id, item_shingles, shared, containment) for each item that a document contains."""
    src, queries = texts(docs, doc_id, text_col), texts(items, item_id, text_col)
    kinds = [src.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()]
    schema = f"id {kinds[0]}, item_id {kinds[1]}, item_shingles int, shared int, containment double"
    out = None
    for block in _blocks(queries, block_bytes):
        held = src.sparkSession.sparkContext.broadcast(ItemSketches(block, width, threshold))
        item_type = queries.schema["id"].dataType

        def run(batches: Iterator[pa.RecordBatch], held=held, item_type=item_type) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            sketches, hasher, kind = held.value, ShingleHasher(), to_arrow_type(item_type)
            for batch in batches:
                for first, part in _chunks(batch, 1):
                    if rows := sketches.matches(part, hasher):
                        n, s = ([r[i] for r in rows] for i in (2, 3))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([first + r[0] for r in rows])), pa.array([sketches.ids[r[1]] for r in rows], type=kind), pa.array(n, pa.int32()), pa.array(s, pa.int32()), pa.array([b / a for a, b in zip(n, s, strict=True)], pa.float64())], names=["id", "item_id", "item_shingles", "shared", "containment"])

        found = src.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents, all columns, that contain no item."""
    at, schema = docs.columns.index(text_col), docs.schema
    for block in _blocks(texts(items, item_id, text_col), block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(ItemSketches(block, width, threshold))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sketches, hasher = held.value, ShingleHasher()
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for first, part in _chunks(batch, at):
                    for r in sketches.matches(part, hasher):
                        clean[first + r[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
