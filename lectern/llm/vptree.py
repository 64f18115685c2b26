"""Nearest neighbours by vantage-point trees, one per shard of vectors.

A tree splits its vectors at the median distance from a vantage point and keeps, for either side, the range of those
distances. A query at distance d from the vantage point is at least max(d - high, low - d) away from all of a side; the
side is skipped if that bound times ``factor`` exceeds the query's k-th best distance so far. Factor 1 is the
triangle inequality and gives exact results; a larger factor skips more.

Vectors are dealt to shards of at most about ``shard_rows`` by a hash of the id. A task holds one shard, builds its tree
once, and all queries stream past it in blocks; each block's k best of the shard go on to be ranked with those of the
other shards. So every vector is shuffled once and every query once a shard, and a task's memory is bounded by a shard and
a block. All queries of a block descend a tree together, so distances are computed as arrays.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids;
vectors of another length than the query's are no candidates; of rows with the same id one takes part; equal distances
rank by id; any number of equal vectors is one leaf; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEAF = 64
_CELLS = 1 << 21  # numbers in one array of differences


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of all queries to all points, the squares summed in order."""
    out = np.empty((len(queries), len(points)))
    step = max(1, _CELLS // max(1, len(queries) * queries.shape[1]))
    for at in range(0, len(points), step):
        part = queries[:, None, :] - points[None, at : at + step, :]
        out[:, at : at + step] = np.sqrt(np.einsum("qpd,qpd->qp", part, part))
    return out


class Tree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = _LEAF, seed: int = 0) -> None:
        self.points, self.ids, self.leaf = points, ids, leaf
        self.random = np.random.default_rng(seed)
        self.root = self._node(np.arange(len(ids))) if len(ids) else None

    def _node(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        vantage = self.points[own[self.random.integers(len(own))]]
        d = distances(vantage[None], self.points[own])[0]
        near = d < np.median(d)
        if not near.any():
            near = d <= np.median(d)
            if near.all():
                return own  # no distance tells them apart
        return vantage, [(d[side].min(), d[side].max(), self._node(own[side])) for side in (near, ~near)]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, ids) of the k nearest with another id than the query's, by distance and id; inf where fewer.
        Also the number of distances computed."""
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.computed = 0
        if self.root is not None and len(queries):
            self._visit(self.root, queries, query_ids, np.arange(len(queries)), best, who, factor)
        return best, who, self.computed

    def _visit(self, node, queries, query_ids, active, best, who, factor) -> None:
        if isinstance(node, np.ndarray):
            d = distances(queries[active], self.points[node])
            ids = self.ids[node]
            self.computed += d.size
            d[query_ids[active][:, None] == ids[None, :]] = np.inf
            for row in np.flatnonzero((d <= best[active, -1][:, None]).any(1)):
                q = active[row]
                keep = np.flatnonzero((d[row] <= best[q, -1]) & np.isfinite(d[row]))
                dist, name = np.r_[best[q], d[row, keep]], np.r_[who[q], ids[keep]]
                order = np.lexsort((name, dist))[: best.shape[1]]
                best[q], who[q] = dist[order], name[order]
            return
        vantage, sides = node
        d = distances(queries[active], vantage[None])[:, 0]
        self.computed += len(d)
        bound = np.stack([np.maximum(np.maximum(d - high, low - d), 0) for low, high, _ in sides], axis=1)
        slack = 1e-9 * (1 + d)  # rounding never prunes
        first = (bound[:, 0] > bound[:, 1]) | ((bound[:, 0] == bound[:, 1]) & (d > sides[0][1]))
        for own, other in ((~first, 0), (first, 1)):
            for side in (other, 1 - other):
                live = own & (factor * bound[:, side] - slack <= best[active, -1])
                if live.any():
                    self._visit(sides[side][2], queries, query_ids, active[live], best, who, factor)


def _usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _searched(batches: Iterator[pa.RecordBatch], k: int, factor: float, block_rows: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query in each (dim, shard) of a partition. Rows come sorted: of a shard the vectors, then the
    queries."""
    held: list[pa.RecordBatch] = []
    shard, tree = None, None

    def block(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(3).to_numpy()

    for whole in batches:
        for at in range(0, whole.num_rows, block_rows):
            part = whole.slice(at, block_rows)
            marks = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)])
            for first, stop in zip(cuts, np.r_[cuts[1:], len(marks)], strict=True):
                own, rows = tuple(marks[first, :2]), part.slice(first, stop - first)
                if own != shard:
                    shard, tree, held = own, None, []
                if not marks[first, 2]:
                    held.append(rows)
                    continue
                if tree is None:
                    tree = Tree(*_distinct(*(np.concatenate(x) for x in zip(*map(block, held), strict=True)))) if held else Tree(np.zeros((0, own[0])), np.zeros(0, np.int64))
                    held = []
                asked, names = block(rows)
                best, who, _ = tree.search(asked, names, k, factor)
                found = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)[found.ravel()]), pa.array(who[found]), pa.array(best[found])], names=["query_id", "id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, shard_rows: int = 1 << 16, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the k nearest other vectors of every vector for which ``is_query`` holds.

    There are as many shards as the cores that work at once, if ``shard_rows`` asks for fewer and each has a thousand rows.
    """
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    base = whole.where(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("dim", F.size("v"))
    n = base.count()
    shards = max(1, math.ceil(n / shard_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 1000))
    dealt = base.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v")
    one_each = base.where("asked").groupBy("dim", "id").agg(F.min("v").alias("v"))
    queries = one_each.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    together = dealt.unionByName(queries).repartitionById(shards, "shard").sortWithinPartitions("dim", "shard", "kind")
    found = together.mapInArrow(lambda batches: _searched(batches, k, factor, block_rows), "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _distinct(points: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and ids; of rows with one id the smallest vector."""
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*points.T[::-1], ids))
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
        points, ids = points[order], ids[order]
    return points, ids
