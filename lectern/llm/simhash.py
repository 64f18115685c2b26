"""SimHash near-duplicates, linked by multi-index hashing.

Fingerprints: ASCII letters are lower-cased, words are runs of anything but ASCII white space, shingles are
``width`` consecutive words with repeats (a shorter text is one shingle, a text without words has fingerprint 0).
A bit is set if it is set in over half of the shingles' XXH64 values (seed 42).

Linking: equal fingerprints meet first, so a group of exact copies is one node however large it is. Each
fingerprint is cut into segments; two fingerprints within ``radius`` bits differ by at most
``radius // segments`` bits in one segment at least, so every fingerprint is entered under each segment's value and
under all values in the small Hamming ball around it. Rows that share a key are compared over all 64 bits. From a
key with many rows only a spanning forest of its links is kept, which joins the same fingerprints in linear space.
Components are found by star rounds on the links.

Defined cases: null text is empty; a row without an id takes the component of its fingerprint, which is null, without
links, if no row of that fingerprint has an id; repeated ids give one row each; other columns are ignored; an empty
table gives no rows. A task holds the distinct fingerprints of one key at a time, and compares those of a key with many
in time that grows with their square; copies do not add to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_batches, texts
from lectern.operators.components import connected_components
from lectern.plans.storage import materialize

BITS = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_PART = 1 << 16  # shingles whose bits are counted at once


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def _remixed(x: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles, for further fingerprints."""
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str, width: int = 3, prints: int = 1) -> list[int]:
    """The first fingerprint is of the XXH64 values, further ones are of values mixed from them."""
    found = words(text)
    if not found:
        return [0] * prints
    n = max(1, len(found) - width + 1)
    digest, seed = xxhash.xxh64_intdigest, 42
    counts = np.zeros((prints, BITS), dtype=np.int64)
    for start in range(0, n, _PART):
        stop = min(n, start + _PART)
        if n == 1:
            shingles = [" ".join(found[:width])]
        else:
            shingles = map(" ".join, zip(*(found[start + k : stop + k] for k in range(width)), strict=True))
        values = np.array([digest(s, seed) for s in shingles], dtype="<u8")
        for k in range(prints):
            own = _remixed(values, k) if k else values
            counts[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, prints: int = 1) -> DataFrame:
    """(id, fp0, fp1, ...): 64 bits each, as signed longs."""
    src, names = texts(docs, id_col, text_col), [f"fp{k}" for k in range(prints)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(c.as_py(), width, prints) for c in batch.column(1)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(prints))], names=["id", *names])

    return map_batches(src, work, ", ".join([f"id {src.schema['id'].dataType.simpleString()}", *(f"{n} long" for n in names)]))


def segment_spans(segments: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _ball(bits: int, reach: int) -> np.ndarray:
    """Masks of all changes of 1 to ``reach`` bits."""
    found = [sum(1 << b for b in pick) for r in range(1, reach + 1) for pick in combinations(range(bits), r)]
    return np.array(found, dtype=np.uint64)


def table_keys(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """(key, fp, node, probe) for each (fp, node): its own segment values, and those in the ball of radius//segments.

    Of two segment values that differ, the larger one probes the smaller: each pair is fetched from one side.
    """
    spans = segment_spans(segments)
    reach = radius // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [_ball(width, reach) for _, width in spans]
        step = max(1, 400_000 // (1 + max(len(b) for b in balls)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                fps, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                for s, ((first, width), ball) in enumerate(zip(spans, balls, strict=True)):
                    value = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    tag = np.uint64(s << 56)
                    keys, rows, probe = [value | tag], [np.arange(len(fps))], [np.zeros(len(fps), dtype=bool)]
                    if len(ball):
                        near = value[:, None] ^ ball[None, :]
                        r, c = np.nonzero(near < value[:, None])
                        keys.append(near[r, c] | tag)
                        rows.append(r)
                        probe.append(np.ones(len(r), dtype=bool))
                    k, r = np.concatenate(keys), np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(fps[r].view(np.int64)), pa.array(ids[r]), pa.array(np.concatenate(probe))], names=["key", "fp", "node", "probe"])

    return nodes.select("fp", "node").mapInArrow(run, "key long, fp long, node long, probe boolean")


def _forest(fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what lies within ``radius`` of one another, one for each row reached."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                got, left = left[near], left[~near]
                a.append(np.full(len(got), nodes[at]))
                b.append(nodes[got])
                queue.extend(got)
    return (np.concatenate(a), np.concatenate(b)) if a else (nodes[:0], nodes[:0])


_SMALL = 8  # rows of a key whose pairs are compared directly


def key_links(key: np.ndarray, fps: np.ndarray, nodes: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that share a key; rows come sorted by key and whole keys are given."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    entered = np.add.reduceat((~probe).astype(np.int64), starts) > 0
    a, b = [], []
    live = np.repeat((sizes > 1) & (sizes <= _SMALL) & entered, sizes)
    k, f, n, p = key[live], fps[live], nodes[live], probe[live]
    for d in range(1, _SMALL):
        if len(k) <= d:
            break
        same = (k[d:] == k[:-d]) & ~(p[d:] & p[:-d]) & (n[d:] != n[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius)
        a.append(n[:-d][same])
        b.append(n[d:][same])
    for i in np.flatnonzero((sizes > _SMALL) & entered):
        s = slice(starts[i], starts[i] + sizes[i])
        x, y = _forest(fps[s], nodes[s], radius)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (nodes[:0], nodes[:0])


def whole_keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The first ``width`` columns of batches sorted by the first, cut between keys only."""
    pending: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        last = cols[0][-1]
        cut = int(np.searchsorted(cols[0], last))  # the last key may go on in the next batch
        pending.append([c[:cut] for c in cols] if cut else cols)
        if cut:
            whole = [np.concatenate(x) for x in zip(*pending, strict=True)]
            pending = [[c[cut:] for c in cols]]
            yield whole
    if pending:
        yield [np.concatenate(x) for x in zip(*pending, strict=True)]


def links(nodes: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """(a, b) links that join all (fp, node) rows within ``radius`` bits; fps are distinct, node is a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_keys(batches, 4):
            a, b = key_links(cols[0], cols[1].view(np.uint64), cols[2], cols[3], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = table_keys(nodes, radius, segments).repartition("key").sortWithinPartitions("key")
    return keys.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, segments: int = 2, prints: int = 1) -> DataFrame:
    """(id, fp0, component): component is the smallest id reachable over links of at most ``radius`` bits.

    With several ``prints``, documents are linked if one of their fingerprints is that near: each has its own errors,
    so more near copies are found at the same radius. Ids are longs.
    """
    names = [f"fp{k}" for k in range(prints)]
    found = materialize(fingerprints(docs, id_col, text_col, width, prints), "simhash")
    nodes = materialize(found.groupBy(*names).agg(F.min("id").alias("node")), "simhash-nodes")
    known = nodes.where("node is not null")
    edges = reduce(DataFrame.unionByName, (links(known.select(F.col(n).alias("fp"), "node"), radius, segments) for n in names))
    components = connected_components(edges)
    classes = nodes.join(components, "node", "left").select(*names, F.coalesce("component", "node").alias("component"))
    return found.join(classes, names).select("id", "fp0", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 5, segments: int = 3, prints: int = 3) -> DataFrame:
    """The documents, all columns, without those that a smaller id stands for; rows that share an id stay or go together.

    One document stands for another if pairs with a 5-word Jaccard similarity of 0.8 or more lead from one to the
    other; fingerprints within ``radius`` bits only propose pairs.
    """
    from lectern.llm.overlap import near_copies

    gone = near_copies(docs, id_col, text_col, width, radius, segments, prints).where("id <> keeper").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
