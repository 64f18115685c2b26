"""Connected components by contraction: nodes are merged round by round, and only links between what is left go on."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.plans.storage import discard, materialize

_REST = 20_000  # links that one task settles


def _to_least(edges: DataFrame) -> DataFrame:
    """(node, rep) of the links (a, b), a >= b: each node goes to its least neighbour or stays."""
    rows = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), "b"))
    return rows.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("rep"))


def _to_hashed(edges: DataFrame, seed: int) -> DataFrame:
    """(node, rep): each node goes to the first of its neighbours and itself in an order by hash, which merges a share of the nodes of
    any graph, also of chains in order; what meets there is named by its least node."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.unionByName(edges.select("a", F.col("a").alias("b"))).unionByName(edges.select(F.col("b").alias("a"), "b"))
    met = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64(F.lit(seed), "b").alias("h"), "b")).alias("x")).select("node", F.col("x.b").alias("at"))
    return met.join(met.groupBy("at").agg(F.min("node").alias("rep")), "at").select("node", "rep")


def _contracted(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """The links between different nodes that are left."""
    ends = edges.join(reps.toDF("a", "x"), "a").join(reps.toDF("b", "y"), "b").where("x <> y")
    return ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _settled(edges: DataFrame) -> DataFrame:
    """(node, rep) of at most ``_REST`` links, in one task."""
    kind = edges.schema["a"].dataType.simpleString()
    like = to_arrow_schema(edges.select(F.col("a").alias("node"), F.col("a").alias("rep")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            path = []
            while above.setdefault(x, x) != x:
                path.append(x)
                x = above[x]
            above.update(dict.fromkeys(path, x))
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
        found = [(x, root(x)) for x in list(above)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), like, strict=True)], schema=like)

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, rep {kind}")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 120, rest: int = _REST) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Self loops keep their node; null endpoints are ignored. Links shrink with each round, and nodes that are merged leave them;
    when ``rest`` links or fewer remain, one task settles them. Only the number of links of a round reaches the driver. The links
    of past rounds leave no files.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    now, told = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc-links"), []
    for turn in range(max_rounds):
        left = now.count()
        if left <= rest:
            break
        told.append(materialize(_to_hashed(now, turn) if turn % 2 else _to_least(now), "cc-nodes"))
        last, now = now, materialize(_contracted(now, told[-1]), "cc-links")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if left or not told:
        told.append(materialize(_settled(now), "cc-nodes"))
    discard(now)
    whole = told.pop()
    for reps in reversed(told):
        further = whole.select(F.col("node").alias("rep"), F.col("rep").alias("_r"))
        whole = reps.join(further, "rep", "left").select("node", F.coalesce("_r", "rep").alias("rep"))
    return whole.withColumnRenamed("rep", "component")
