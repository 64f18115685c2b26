"""Alignment of two tokenizers' tokens, with corpus-wide counts of the pairs of ids that overlap.

A text is encoded by byte-level BPE (A) and by a piece model (B); a piece model puts a space before the text, so both cover the
bytes of space + text. Offsets where tokens of both end cut the tokens into groups; a link is a token of A and one of B
whose bytes overlap. A pair's count is the number of documents that hold it linked.

First pass: documents are aligned, and each task writes the pairs it met with the number of its documents. The distinct pairs
get a minimal perfect hash (``perfect``), built bucket by bucket. Each task's counts become a dense vector indexed by it, cut
into blocks; vectors are summed up a tree of a fixed fan-in, so no task reads more than its fan-in of them. Second pass:
documents are aligned again, and each link's count is looked up, its key verified.

Vectors and hash are broadcast, behind a check: beyond ``most_pairs`` distinct pairs (17 bytes each) nothing is, and links are
joined with the counts instead. Results are the same.

Both tokenizers have a border wherever a space or line feed follows something that is no white space, since no piece spans
such two characters (checked when a model is read). What lies between two such places is encoded once by the
libraries and its ids kept in a bounded table; texts are worked on in parts of about a million characters cut there.

Defined cases: texts that are null, empty, or whose A or B bytes are not those of space + text (a literal U+2581, which a piece
model can't give back) have no tokens and no groups; special tokens' strings are plain text; rows that share an id are rows of
their own, each counted as a document; an empty table stays empty; the results have named columns of their own, so others
can't clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import bpe, perfect
from lectern.llm.common import texts
from lectern.plans.storage import discard, materialize

A_FILE, B_FILE = bpe.DEFAULT_VOCABULARY, "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BLOCK = 1 << 20  # characters aligned at once
_CELLS = 4096  # counts in a block of a vector
_FAN = 16  # vectors that are summed at once
_KEPT = 1 << 22  # pairs that a task holds before it writes them
_HASHED = 1 << 14  # pairs in a bucket of the hash, about


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of what lies between two common borders."""

    def __init__(self, a_file: str, b_file: str, room: int = 400_000) -> None:
        import sentencepiece
        import tiktoken

        self.a = bpe.Vocabulary(a_file)
        self.plain = tiktoken.Encoding("a", pat_str=bpe.WORDS, mergeable_ranks=self.a.ids, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        odd = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(n)]
        self.b_bytes = [b"" if odd[i] else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        inner = {p[k : k + 2] for i, p in enumerate(names) if not (odd[i] or self.b.is_byte(i)) for k in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] or "\n" in x for x in inner):
            raise ValueError("a piece spans the border between a word and white space")
        self.a_len = np.array(self.a.length, np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.room, self.held, self.old, self.bad = room, {}, {}, set()
        white = bpe.WHITE
        self.pieces = re.compile(f"[{white}]*[^{white}]+(?:(?![ \\n])[{white}]+[^{white}]*)*|[{white}]+")
        self.first = self.b.piece_to_id(SPACE)
        names = [str(i).encode() for i in range(max(self.a.size, n))]
        self.digits, self.digits_at = np.frombuffer(b"".join(names), np.uint8), np.r_[0, np.cumsum([len(x) for x in names])].astype(np.int64)

    def _learn(self, new: list[str]) -> None:
        found = self.b.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        for piece, b in zip(new, found, strict=True):
            if piece == " ":
                b = [self.first]
            elif piece[0] != " ":  # the model has put a space before it, which is a token of its own there
                b = b[1:] if b and b[0] == self.first else []
            a, whole = self.plain.encode_ordinary(piece), piece.encode("utf-8", "replace")
            if b"".join(map(self.b_bytes.__getitem__, b)) != whole or b"".join(map(self.a.tokens.__getitem__, a)) != whole:
                self.bad.add(piece)
            self.held[piece] = array("i", [*a, *(~i for i in b)]).tobytes()

    def encode(self, parts: list[str]) -> list[np.ndarray | None]:
        """The ids of each part, those of B as complements; None if the bytes are not the text's."""
        cut = [self.pieces.findall(p) for p in parts]
        seen = set().union(*cut)
        if len(self.held) > self.room:  # what comes again is taken back from the old ones, the rest goes
            self.old, self.held = self.held, {}
            self.bad &= self.old.keys()
        held, old = self.held, self.old
        new = [p for p in seen if p not in held]
        held.update((p, old[p]) for p in new if p in old)
        self._learn([p for p in new if p not in old])
        get, bad = held.__getitem__, self.bad
        return [None if SPACE in p or bad and not bad.isdisjoint(own) else np.frombuffer(b"".join(map(get, own)), np.int32) for p, own in zip(parts, cut, strict=True)]


class Aligned:
    """Tokens, links and groups of texts laid end to end: ids a and b, link k between tokens ia[k] and ib[k], ``ends`` tells
    the links that end a group; part j has the links from links[j] on, and so for tokens and groups."""

    def __init__(self, pair: Pair, found: list[np.ndarray]) -> None:
        x = np.concatenate([np.zeros(0, np.int32), *found])
        is_a = x >= 0
        self.pair, self.a, self.b = pair, x[is_a], ~x[~is_a]
        a_end, b_end = np.cumsum(pair.a_len[self.a]), np.cumsum(pair.b_len[self.b])
        total = int(a_end[-1]) if len(a_end) else 0
        at_a, at_b = np.zeros(total + 1, np.int8), np.zeros(total + 1, np.int8)
        at_a[a_end] = 1
        at_b[b_end] = 1
        places = np.flatnonzero(at_a | at_b)
        a_here, b_here = at_a[places], at_b[places]
        self.ia, self.ib = np.cumsum(a_here, dtype=np.int64) - a_here, np.cumsum(b_here, dtype=np.int64) - b_here
        self.ends = (a_here & b_here).astype(bool)
        n_a = np.array([0, *(int((f >= 0).sum()) for f in found)])
        self.a_from = np.cumsum(n_a)
        self.b_from = np.cumsum(np.array([0, *map(len, found)]) - n_a)
        self.links = np.r_[0, np.searchsorted(places, a_end[self.a_from[1:] - 1], "right")] if len(found) else np.zeros(1, np.int64)
        self.groups = np.r_[0, np.cumsum(self.ends)][self.links]
        last = np.flatnonzero(self.ends)
        self.a_of, self.b_of = np.diff(np.r_[0, self.ia[last] + 1]), np.diff(np.r_[0, self.ib[last] + 1])  # tokens in each group

    def keys(self) -> np.ndarray:
        return self.a[self.ia].astype(np.int64) << 32 | self.b[self.ib]

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """All groups as text, ids in order with ``,`` between, ``|`` before B's and ``;`` after the group, and the place where each
        part ends there."""
        groups = len(self.a_of)
        a_group, b_group = np.repeat(np.arange(groups), self.a_of), np.repeat(np.arange(groups), self.b_of)
        a_upto, b_upto = np.cumsum(self.a_of), np.cumsum(self.b_of)
        a_at = np.arange(len(self.a)) + (b_upto - self.b_of)[a_group]
        b_at = np.arange(len(self.b)) + a_upto[b_group]
        ids, sign = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[a_at], ids[b_at] = self.a, self.b
        sign[a_at[a_upto - 1]], sign[b_at[b_upto - 1]] = ord("|"), ord(";")
        starts = self.pair.digits_at[ids]
        sizes = self.pair.digits_at[ids + 1] - starts + 1
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.pair.digits[np.minimum(np.repeat(starts - ends + sizes, sizes) + np.arange(total), len(self.pair.digits) - 1)]
        out[ends - 1] = sign
        part_ends = np.r_[0, ends][(self.a_from + self.b_from)[1:]]
        return out, part_ends


def _aligned(pair: Pair, cells: pa.Array) -> Iterator[tuple[int, Aligned | None, int]]:
    """(row, block, place in it) of each part of each text, rows in order. No block: the text has no tokens, whatever came of
    it before."""
    waiting: list[tuple[int, str | None]] = []

    def flush() -> Iterator[tuple[int, Aligned | None, int]]:
        found = iter(pair.encode([p for _, p in waiting if p is not None]))
        ids = [(row, None if p is None else next(found)) for row, p in waiting]
        block = Aligned(pair, [f for _, f in ids if f is not None])
        at = -1
        for row, f in ids:
            at += f is not None
            yield (row, None, 0) if f is None else (row, block, at)
        waiting.clear()

    held = 0
    for row, cell in enumerate(cells):
        text = cell.as_py()
        for part in bpe.parts(" " + text) if text else [None]:
            waiting.append((row, part))
            held += len(part or "")
            if held >= _BLOCK:
                yield from flush()
                held = 0
    yield from flush()


_pairs: dict[tuple[str, str], Pair] = {}  # one in each Python worker


def _shipped(df: DataFrame, a_file: str, b_file: str) -> Callable[[], Pair]:
    a_path, b_path = bpe.shipped(df.sparkSession, a_file), bpe.shipped(df.sparkSession, b_file)

    def get() -> Pair:
        names = (a_path(), b_path())
        if names not in _pairs:
            _pairs[names] = Pair(*names)
        return _pairs[names]

    return get


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(id, groups): the groups of each text in order, each with the ids of A and of B."""
    src = texts(docs, id_col, text_col)
    pair = _shipped(src, a_file, b_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.by_size(batches, 1, 1 << 20):
            rows: list[list | None] = [[] for _ in range(batch.num_rows)]
            for row, block, j in _aligned(pair(), batch.column(1)):
                if block is None or rows[row] is None:
                    rows[row] = None
                    continue
                a, b = int(block.a_from[j]), int(block.b_from[j])
                for g in range(block.groups[j], block.groups[j + 1]):
                    rows[row].append({"a": block.a[a : a + block.a_of[g]].tolist(), "b": block.b[b : b + block.b_of[g]].tolist()})
                    a, b = a + block.a_of[g], b + block.b_of[g]
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r or [] for r in rows], kind)], names=["id", "groups"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, groups array<struct<a: array<int>, b: array<int>>>")


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    whole, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return whole, np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(whole)).astype(np.int64)


def _met(src: DataFrame, pair: Callable[[], Pair]) -> DataFrame:
    """First pass: (key, n), the pairs that each task met, with the number of its documents that link them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        fresh = 0
        for batch in bpe.by_size(batches, 1, 1 << 20):
            own: list[np.ndarray | None] = [np.zeros(0, np.int64)] * batch.num_rows
            last, known = None, None
            for row, block, j in _aligned(pair(), batch.column(1)):
                if block is None or own[row] is None:
                    own[row] = None
                    continue
                if block is not last:
                    last, known = block, block.keys()
                part = np.unique(known[block.links[j] : block.links[j + 1]])
                own[row] = part if not len(own[row]) else np.union1d(own[row], part)
            waiting += [k for k in own if k is not None and len(k)]
            fresh += sum(len(k) for k in own if k is not None)
            if fresh > _KEPT // 2:
                keys, counts = _merged([keys, *waiting], [counts, np.ones(fresh, np.int64)])
                waiting, fresh = [], 0
                if len(keys) > _KEPT:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = _merged([keys, *waiting], [counts, np.ones(fresh, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return src.mapInArrow(run, "key long, n long")


def _hash(keys: DataFrame, n: int) -> perfect.Table:
    """The hash of n distinct keys, its buckets built by tasks."""
    buckets = max(1, n // _HASHED)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(perfect.bucket_of(batch.column(0).to_numpy(), buckets)), batch.column(0)], names=["bucket", "key"])

    def build(bucket: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sizes, words, order = perfect.build(rows.column("key").to_numpy())
        return pa.table({"bucket": [bucket[0].as_py()], "sizes": [sizes.tobytes()], "words": [words.tobytes()], "keys": [order.tobytes()]})

    built = keys.mapInArrow(dealt, "bucket long, key long").groupBy("bucket").applyInArrow(build, "bucket long, sizes binary, words binary, keys binary").collect()
    return perfect.Table(buckets, [(r["bucket"], np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["words"], np.uint64), np.frombuffer(r["keys"], np.int64)) for r in built])


def _summed(met: DataFrame, table: perfect.Table) -> np.ndarray:
    """Each task's dense vector of counts, indexed by the hash, in blocks, summed up a tree."""
    sent, n = met.sparkSession.sparkContext.broadcast(table), len(table.keys)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-n // _CELLS) * _CELLS, np.int64)
        for batch in batches:
            at = sent.value.numbers(batch.column(0).to_numpy())
            if (at < 0).any():
                raise ValueError("the documents changed between two passes")
            np.add.at(total, at, batch.column(1).to_numpy())
        for k, cells in enumerate(total.reshape(-1, _CELLS)):
            if cells.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([cells.tobytes()])], names=["block", "cells"])

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c.as_py(), np.int64) for c in rows.column("cells")], axis=0)
        return pa.table({"block": [key[0].as_py()], "part": [key[1].as_py()], "cells": [total.tobytes()]})

    vectors = materialize(met.mapInArrow(vector, "block long, cells binary").withColumn("part", F.spark_partition_id()), "alignment-vectors")
    parts = (vectors.agg(F.max("part")).first()[0] or 0) + 1
    level = vectors
    while True:
        parts = -(-parts // _FAN)
        level = level.withColumn("part", F.expr(f"part div {_FAN}").cast("int")).groupBy("block", "part").applyInArrow(add, "block long, part long, cells binary")
        if parts == 1:
            break
    out = np.zeros(-(-n // _CELLS) * _CELLS, np.int64)
    for r in level.collect():
        out[r["block"] * _CELLS : (r["block"] + 1) * _CELLS] = np.frombuffer(r["cells"], np.int64)
    discard(vectors)
    sent.unpersist()
    return out[:n]


SUMMARY = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _summaries(src: DataFrame, pair: Callable[[], Pair], counted: object = None) -> DataFrame:
    """Second pass: sums of each document; with ``counted`` (the broadcast hash, counts and each pair's being its A id's best) also
    n_best and count_sum, else its links as keys and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.by_size(batches, 1, 1 << 20):
            n = batch.num_rows
            sums, dead, digests = np.zeros((n, 6), np.int64), np.zeros(n, bool), [None] * n
            keys: list[list[np.ndarray]] = [[] for _ in range(n)]
            last = None
            for row, block, j in _aligned(pair(), batch.column(1)):
                if block is None or dead[row]:
                    dead[row] = True
                    continue
                if block is not last:
                    last, (written, until), known = block, block.written(), block.keys()
                    if counted is not None:
                        table, counts, best = counted.value
                        at = table.numbers(known)
                        if (at < 0).any():
                            raise ValueError("the documents changed between two passes")
                        count_upto, best_upto = np.r_[0, np.cumsum(counts[at])], np.r_[0, np.cumsum(best[at])]
                a, b = block.links[j], block.links[j + 1]
                sums[row, :4] += (block.a_from[j + 1] - block.a_from[j], block.b_from[j + 1] - block.b_from[j], block.groups[j + 1] - block.groups[j], b - a)
                if counted is None:
                    keys[row].append(known[a:b])
                else:
                    sums[row, 4:] += (best_upto[b] - best_upto[a], count_upto[b] - count_upto[a])
                text = written[until[j - 1] if j else 0 : until[j] - 1]  # without the last sign
                if digests[row] is None:
                    digests[row] = hashlib.sha256(text)
                else:
                    digests[row].update(b";")
                    digests[row].update(text)
            sums[dead] = 0
            columns = {"id": batch.column(0)} | {c: pa.array(sums[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            columns["groups_sha256"] = pa.array(["" if x is None or gone else x.hexdigest() for x, gone in zip(digests, dead, strict=True)])
            if counted is None:
                own = [np.unique(np.concatenate([np.zeros(0, np.int64), *([] if gone else k)]), return_counts=True) for k, gone in zip(keys, dead, strict=True)]
                columns |= {"keys": pa.array([k.tolist() for k, _ in own], pa.list_(pa.int64())), "times": pa.array([t.tolist() for _, t in own], pa.list_(pa.int64()))}
            else:
                columns |= {"n_best": pa.array(sums[:, 4]), "count_sum": pa.array(sums[:, 5])}
            yield pa.RecordBatch.from_pydict(columns)

    kind = f"id {src.schema['id'].dataType.simpleString()}, {SUMMARY}"
    return src.mapInArrow(run, f"{kind}, keys array<long>, times array<long>" if counted is None else f"{kind}, n_best long, count_sum long")


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(a, b, n): how many documents hold each pair of ids linked."""
    src = texts(docs, id_col, text_col)
    met = _met(src, _shipped(src, a_file, b_file))
    return met.groupBy("key").agg(F.sum("n").alias("n")).select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n")


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, most_pairs: int = 4_000_000) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each text; n_best counts links whose pair has the most
    documents of its A id's pairs, count_sum adds up all links' counts."""
    src = texts(docs, id_col, text_col)
    pair = _shipped(src, a_file, b_file)
    met = materialize(_met(src, pair), "alignment-pairs")
    distinct = materialize(met.select("key").distinct(), "alignment-keys")
    n = distinct.count()
    if n > most_pairs:
        return _joined(_summaries(src, pair), met)
    table = _hash(distinct, n)
    counts = _summed(met, table)
    a = (table.keys >> 32).astype(np.int64)
    top = np.zeros(int(a.max()) + 1 if n else 0, np.int64)
    np.maximum.at(top, a, counts)
    discard(met)
    discard(distinct)
    return _summaries(src, pair, src.sparkSession.sparkContext.broadcast((table, counts, counts == top[a])))


def _joined(found: DataFrame, met: DataFrame) -> DataFrame:
    """The counts by a join on the pair, for more of them than are broadcast. Rows are dealt by pair: a frequent one is a row per
    document, and skewed joins split it."""
    counts = met.groupBy("key").agg(F.sum("n").alias("n"))
    tops = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("top"))
    counts = counts.join(tops, F.shiftright("key", 32) == F.col("a")).select("key", "n", (F.col("n") == F.col("top")).alias("best"))
    rows = materialize(found.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    links = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    sums = links.join(counts, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("keys", "times").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])
