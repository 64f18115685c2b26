"""Near copies by exact similarity: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Words are those of the SimHash operator; shingles are ``WIDTH`` consecutive words (a shorter text is one shingle, a
text without words has none). Texts with equal sets are one node, named by a hash of the set.

Search, in two steps that only propose pairs; every pair is verified by its sets before it links anything:

1. Fingerprints within a radius, of which a spanning forest is kept. That joins large groups of near copies with few
   pairs, and may miss some.
2. A prefix filter, which misses none: shingles have one order everywhere, rare ones first, and two sets of that
   similarity share one of the first ``n - ceil(0.8 n) + 1``. Beyond these prefixes they can share no more than the
   longer of the two rests holds, so the pair must share enough of the prefixes themselves (near half of them, for sets
   of one size): a passage that two texts quote is not enough. Only pairs that step 1 has not joined are proposed. What
   counts as rare is estimated from a bounded sample first. Texts with a shingle among these that more than ``_CROWD``
   have are set apart: their shingles are counted exactly among them, and pairs of two such texts are proposed by
   prefixes in that order, in which what many texts quote comes last. There each text meets the texts of its key that have
   fewest shingles of their own first (what copies were made from has none), and only what is not joined by that meets the
   rest. There a pair is told only if the texts' sketches can be those of similar sets: a sketch has the parity of how many
   shingles fall on each bit, and two sketches differ in no more bits than the sets in shingles, so no similar pair is lost.
   Counts decide how many pairs are proposed, never the result.

Shingles are compared by their XXH64 values. Every shuffle is linear in the texts. Among texts that share more than four
fifths of their shingles with others, have near lengths, and were not joined before, sketches are compared pairwise in memory;
the pairs told are few where sets have up to some 700 shingles, beyond which sketches of ``SKETCH`` bits tell less.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.common import map_batches, sliced, texts
from lectern.operators.components import connected_components
from lectern.plans.storage import discard, materialize, shared_dir

WIDTH = 5
_TOLD = 1 << 20  # pairs that a task counts at once
_CROWD = 8  # texts of a key whose pairs are told without counting exactly
_FIRST = 3  # texts of a key that all others of it meet first
SKETCH = 512  # bits, a multiple of 64
SAMPLE, COMMON = 4_000, 100_000  # texts of the sample, and shingles that are known to be common


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct XXH64 values of the text's shingles."""
    words = simhash.words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(WIDTH, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(" ".join(s), 42) for s in zip(*(words[k:] for k in range(width)), strict=False)], dtype=np.uint64))


def set_name(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def similar(shared: int, n: int, m: int) -> bool:
    """shared / (n + m - shared) >= 4/5, in whole numbers."""
    return shared * 9 >= (n + m) * 4


def least_shared(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many shingles the prefixes of similar sets of n and m shingles share at least."""
    rest = np.maximum((4 * n + 4) // 5, (4 * m + 4) // 5) - 1
    return np.maximum(1, (4 * (n + m) + 8) // 9 - rest)


def may_be_similar(n: np.ndarray, alone: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles, of which so many are in no other set, can share enough."""
    return 9 * np.minimum(n - alone, m - other) >= 4 * (n + m)


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each of ``SKETCH`` bits, as longs."""
    odd = np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches_fit(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with sketches x and y, a row each, can be similar: similar sets differ in at most
    (n + m) / 9 shingles, and each of these turns one bit at most. Without columns they can."""
    return 9 * np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64) <= n + m


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, one of which any similar set has among its own."""
    n = len(own)
    if not n:
        return own
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))[: n - (4 * n + 4) // 5 + 1]]


def common_shingles(src: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample have, sorted, and in how many they are."""
    total = src.count()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    some = src if total <= SAMPLE else src.where(F.pmod(F.xxhash64("id"), F.lit(total)) < SAMPLE)
    found = some.mapInArrow(work, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas()
    values, counts = found["shingle"].to_numpy(dtype=np.int64).view(np.uint64), found["n"].to_numpy(dtype=np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def _group_pairs(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of nodes of a key, sorted by size, that may be similar and lie in different components, and what they
    must share. Columns beyond the fifth are their sketches."""
    key, size, node, comp, alone = cols[:5]
    drawn = np.stack(cols[5:], axis=1) if len(cols) > 5 else np.zeros((len(key), 0), dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    live = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    k, n, v, c, u, x = key[live], size[live], node[live], comp[live], alone[live], drawn[live]
    for d in range(1, 8):
        if len(k) <= d:
            break
        near = (k[d:] == k[:-d]) & (4 * n[d:] <= 5 * n[:-d]) & (c[d:] != c[:-d]) & may_be_similar(n[:-d], u[:-d], n[d:], u[d:]) & sketches_fit(n[:-d], x[:-d], n[d:], x[d:])
        yield v[:-d][near], v[d:][near], least_shared(n[:-d][near], n[d:][near])
    for i in np.flatnonzero(sizes > 8):
        s = slice(starts[i], starts[i] + sizes[i])
        n, v, c, u, x = size[s], node[s], comp[s], alone[s], drawn[s]
        if c.min() == c.max():
            continue
        ends = np.searchsorted(4 * n, 5 * n, side="right")
        for at, end in enumerate(ends):
            far = (c[at + 1 : end] != c[at]) & may_be_similar(n[at], u[at], n[at + 1 : end], u[at + 1 : end])
            far[far] = sketches_fit(n[at], x[at], n[at + 1 : end][far], x[at + 1 : end][far])
            if far.any():
                yield np.full(int(far.sum()), v[at]), v[at + 1 : end][far], least_shared(n[at], n[at + 1 : end][far])


def prefix_pairs(keyed: DataFrame, crowd: int | None = None) -> DataFrame:
    """(a, b, need, shared) of the (key, n, node, component, alone) rows: pairs that share keys, how many they must share to be
    similar, and how many they do. With ``crowd``, keys of more rows tell their nodes only, as (a, null, 0, 0). Further
    columns are the nodes' sketches, and pairs that can't be similar by these are not told.

    Each pair is told once for each key that it shares, and counted; counting begins in the task.
    """

    def told(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b, need = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        shared = np.diff(np.r_[first, len(a)])
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(need[first]), pa.array(shared)], names=["a", "b", "need", "shared"])

    def crowded(nodes: np.ndarray) -> pa.RecordBatch:
        nodes, zero = np.unique(nodes), pa.array(np.zeros(len(np.unique(nodes)), dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), zero, zero], names=["a", "b", "need", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for whole in simhash.whole_keys(batches, width):
            if crowd is not None:
                first = np.flatnonzero(np.r_[True, whole[0][1:] != whole[0][:-1]])
                sizes = np.diff(np.r_[first, len(whole[0])])
                many = np.repeat(sizes > crowd, sizes)
                if many.any():
                    yield crowded(whole[2][many])
                    whole = [c[~many] for c in whole]
                    if not len(whole[0]):
                        continue
            for some in _group_pairs(whole):
                if len(some[0]):
                    found.append(some)
                    size += len(some[0])
                if size > _TOLD:
                    yield told(found)
                    found, size = [], 0
        if found:
            yield told(found)

    given = ("key", "n", "node", "component", "alone")
    drawn = [c for c in keyed.columns if c not in given]
    width = len(given) + len(drawn)
    dealt = keyed.select(*given, *drawn).repartition("key").sortWithinPartitions("key", "n")
    return dealt.mapInArrow(run, "a long, b long, need long, shared long").groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("shared").alias("shared"))


def counted_prefixes(texts_of: DataFrame) -> DataFrame:
    """(node, key, alone): the prefixes of the nodes of (node, text) rows, in the order of exact counts among them.
    Shingles that only one of them has come first in every prefix and are left out; ``alone`` is how many a node has."""

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, own = batch.column(0).to_numpy(), [shingle_set(c.as_py()) for c in batch.column(1)]
        own = [s if set_name(s) == name else s[:0] for s, name in zip(own, names.tolist(), strict=True)]  # not another text under the same id
        sizes = np.array([len(s) for s in own], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(names, sizes)), pa.array(np.repeat(sizes, sizes))], names=["key", "node", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n in simhash.whole_keys(batches, 3):
            order = np.lexsort((node, key))
            key, node, n = key[order], node[order], n[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # rows that repeat
            key, node, n = key[once], node[once], n[once]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[first, len(key)])
            count = np.repeat(sizes, sizes)
            kept = count > 1
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (key, node, n, count)], names=["key", "node", "n", "count"])

    every = map_batches(texts_of.select("node", "text"), shingles, "key long, node long, n long").repartition("key").sortWithinPartitions("key")
    shared = every.mapInArrow(counted, "key long, node long, n long, count long")
    ordered = shared.groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("count", "key"))).alias("own"))
    alone, prefix_size = F.col("n") - F.size("own"), F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1
    taken = F.slice("own", F.lit(1), F.greatest(prefix_size - alone, F.lit(0)).cast("int"))
    return ordered.select("node", F.explode(F.transform(taken, lambda x: x["key"])).alias("key"), alone.cast("long").alias("alone"))


def first_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b) of the (key, n, node, component, alone) rows: each node with the first few of its key, of near size and in
    another component. Linear in the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, node, comp, _ in simhash.whole_keys(batches, 5):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            for k in range(_FIRST):
                at = np.repeat(starts + np.minimum(k, sizes - 1), sizes)
                fit = (comp != comp[at]) & (4 * n <= 5 * n[at]) & (4 * n[at] <= 5 * n)
                a, b = node[fit], node[at][fit]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = keyed.select("key", "n", "node", "component", "alone").repartition("key").sortWithinPartitions("key", "alone", "n", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _by_id(src: DataFrame) -> tuple[DataFrame, str]:
    """The texts as a table in buckets of their ids, so that looking some up again and again moves them once."""
    spark, name = src.sparkSession, f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = src.repartition(n, "id").sortWithinPartitions("id").write.option("path", f"{shared_dir(spark)}/{name}")
    dealt.bucketBy(n, "id").sortBy("id").saveAsTable(name, format="parquet")
    return spark.table(name), name


def verified(pairs: DataFrame, nodes: DataFrame, src: DataFrame) -> DataFrame:
    """The (a, b) whose sets are similar; texts travel, which take less room than sets, and of nodes that occur only."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    own = src.join(nodes.select("id", "node").join(wanted, "node"), "id").select("node", "text")
    left = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[int, np.ndarray] = {}
        found: tuple[list[int], list[int]] = ([], [])

        def shingles(name: int, text: str) -> np.ndarray | None:
            if name not in sets:
                one = shingle_set(text)
                if set_name(one) != name:  # another text under the same id
                    return None
                sets[name] = one
            return sets[name]

        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one, other = shingles(a, x), shingles(b, y)
            if one is not None and other is not None and similar(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other)):
                found[0].append(a)
                found[1].append(b)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    return materialize(map_batches(both, work, "a long, b long").distinct(), "overlap-verified")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 5, segments: int = 3, prints: int = 3) -> DataFrame:
    """(id, keeper) of the documents with ids: keeper is the smallest id reachable over similar pairs."""
    names, drawn = [f"fp{k}" for k in range(prints)], [f"sketch{k}" for k in range(SKETCH // 64)]
    src = texts(docs, id_col, text_col).where("id is not null")
    common, counts = common_shingles(src)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [c.as_py() for c in batch.column(1)]
        sets = [shingle_set(t) for t in rows]
        fps = np.array([simhash.fingerprint(t, width, prints) for t in rows], dtype=np.uint64).reshape(-1, prints).view(np.int64)
        keys = [prefix(s, common, counts).astype(np.uint32).view(np.int32) for s in sets]
        odd = np.array([sketch(s) for s in sets], dtype=np.int64).reshape(-1, len(drawn))
        columns = [batch.column(0), pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(fps[:, k]) for k in range(prints)), *(pa.array(c) for c in odd.T)], names=["id", "node", "n", "keys", *names, *drawn])

    kind = src.schema["id"].dataType.simpleString()
    found = materialize(map_batches(src, work, ", ".join([f"id {kind}, node long, n long, keys array<int>", *(f"{x} long" for x in (*names, *drawn))])), "overlap")
    nodes = materialize(found.groupBy("node").agg(F.min("id").alias("id"), *(F.first(x).alias(x) for x in ("n", "keys", *names, *drawn))), "overlap-nodes")

    near = reduce(DataFrame.unionByName, (simhash.links(nodes.select(F.col(x).alias("fp"), "node"), radius, segments) for x in names))
    near = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "overlap-near")
    rows, table_name = _by_id(src)
    first = verified(near, nodes, rows)
    joined = materialize(connected_components(first), "overlap-joined")

    placed = materialize(nodes.join(joined, "node", "left").select("node", "n", "id", "keys", F.coalesce("component", "node").alias("component")), "overlap-placed")
    told = materialize(prefix_pairs(placed.select("node", "n", "component", F.explode("keys").alias("key"), F.lit(0).cast("long").alias("alone")), _CROWD), "overlap-told")
    crowd = materialize(told.where("b is null").select(F.col("a").alias("node")), "overlap-crowd")
    among = crowd.select(F.col("node").alias("a"), F.lit(True).alias("a_in"))
    pairs = told.where("b is not null and shared >= need").join(among, "a", "left").join(among.toDF("b", "b_in"), "b", "left").where("a_in is null or b_in is null").select("a", "b")
    apart = materialize(placed.join(crowd, "node").select("node", "n", "id", "component"), "overlap-apart")
    keys = materialize(apart.select("node", "n", "component").join(counted_prefixes(rows.join(apart.select("id", "node"), "id")), "node"), "overlap-keys")
    met = materialize(first_pairs(keys).join(near, ["a", "b"], "left_anti"), "overlap-met")
    third = verified(met, nodes, rows)
    again = materialize(connected_components(first.unionByName(third)), "overlap-again").toDF("node", "_c")
    renamed = keys.join(again, "node", "left").join(nodes.select("node", *drawn), "node").select("key", "n", "node", F.coalesce("_c", "component").alias("component"), "alone", *drawn)
    further = prefix_pairs(renamed).where("shared >= need").select("a", "b")
    known = near.unionByName(met)
    rest = materialize(pairs.unionByName(further).distinct().join(known, ["a", "b"], "left_anti"), "overlap-rest")
    second = verified(rest, nodes, rows).unionByName(third)
    components = materialize(connected_components(first.unionByName(second)), "overlap-components")
    for read in (near, first, joined, placed, told, crowd, apart, keys, met, third, again, rest, rows):
        discard(read)
    src.sparkSession.sql(f"DROP TABLE {table_name}")

    labelled = nodes.select("id", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keepers = labelled.join(labelled.groupBy("component").agg(F.min("id").alias("keeper")), "component").select("node", "keeper")
    return found.select("id", "node").join(keepers, "node").select("id", "keeper")
