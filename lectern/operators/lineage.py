"""Building one lineage graph per theme: the steps in their order, each seeing what the one before left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import dedup
from lectern.operators.classify import guard
from lectern.operators.graph import bounded_bfs, reachable
from lectern.plans.storage import materialize


@dataclass(frozen=True)
class Settings:
    depth: int = 2
    width: int = 8
    min_support: int = 1
    seed_gap: int = 5
    low_impact: float = 100_000.0
    min_rationale: int = 6


STRONG = ("supersedes", "successor", "extends")


def confirm_support(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Non-seed nodes need so many distinct neighbours inside the graph."""
    both = edges.select("graph_id", F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select("graph_id", F.col("dst").alias("id"), F.col("src").alias("other")))
    supported = both.groupBy("graph_id", "id").agg(F.countDistinct("other").alias("n")).where(F.col("n") >= least).select("graph_id", "id")
    return nodes.where("is_focus").unionByName(nodes.where("not is_focus").join(supported, ["graph_id", "id"], "left_semi"))


def drop_before_seeds(nodes: DataFrame, edges: DataFrame, gap: int) -> DataFrame:
    """Nodes far older than the oldest seed stay only with a strong edge."""
    oldest = nodes.where("is_focus").groupBy("graph_id").agg((F.min("year") - gap).alias("limit"))
    strong = edges.where(F.col("relation").isin(*STRONG))
    tied = strong.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("tied", F.lit(True))
    kept = nodes.join(oldest, "graph_id", "left").join(tied, ["graph_id", "id"], "left")
    return kept.where(F.col("limit").isNull() | (F.col("year") >= F.col("limit")) | F.coalesce("tied", F.lit(False)) | F.col("is_focus")).drop("limit", "tied")


def prune_low_impact(nodes: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Leaves with little impact that nothing in the graph cites and no strong edge touches go."""
    cited = edges.select("graph_id", F.col("src").alias("id")).distinct()
    strong = edges.where(F.col("relation").isin(*STRONG)).select("graph_id", F.col("dst").alias("id")).distinct()
    weak = nodes.where((F.col("impact") < least) & ~F.col("is_focus")).join(cited, ["graph_id", "id"], "left_anti").join(strong, ["graph_id", "id"], "left_anti").select("graph_id", "id")
    return nodes.join(weak, ["graph_id", "id"], "left_anti")


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("graph_id", F.col("id").alias(end)), ["graph_id", end], "left_semi")
    return edges


def with_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Marks the focus node of highest degree, smallest id, of each graph; edgeless nodes that are no focus go."""
    degree = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).groupBy("graph_id", "id").agg(F.count("*").alias("degree"))
    ranked = nodes.join(degree, ["graph_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0))).where("is_focus or degree > 0")
    order = Window.partitionBy("graph_id").orderBy(F.desc("is_focus"), F.desc("degree"), "id")
    return ranked.withColumn("is_root", (F.row_number().over(order) == 1) & F.col("is_focus"))


def build(nodes: DataFrame, edges: DataFrame, survey: Column, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges with relation and confidence) of the lineage of nodes(graph_id, id, year, impact, is_focus) over edges(graph_id, src, dst,
    dst_year, relation, rationale): expansion from the seeds, guards, support, age, impact, direction and root."""
    seeds = nodes.where("is_focus").select("graph_id", F.col("id").alias("node"))
    reached = bounded_bfs(seeds, edges, settings.depth, settings.width, [F.desc("dst_year"), F.asc("dst")]).select("graph_id", F.col("node").alias("id"))
    own = materialize(nodes.join(reached, ["graph_id", "id"], "left_semi"), "lineage-nodes")
    stated = edges.where(F.char_length(F.trim("rationale")) >= settings.min_rationale).select("graph_id", "src", "dst", "relation")
    links = guard(inside(stated, own).withColumn("confidence", F.lit(0.8)), survey, F.lit(False))
    links = materialize(dedup.one_direction(links, [F.desc("confidence"), F.asc("src")]), "lineage-edges")
    own = confirm_support(own, links, settings.min_support)
    own = drop_before_seeds(own, inside(links, own), settings.seed_gap)
    own = materialize(prune_low_impact(own, inside(links, own), settings.low_impact), "lineage-kept")
    links = materialize(inside(links, own), "lineage-links")
    return with_root(own, links), links


def contract(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, violations) of a built artifact."""
    from lectern.operators.quality import violations

    twice = nodes.groupBy("graph_id", "id").count().where("count > 1")
    repeated = edges.groupBy("graph_id", "src", "dst").count().where("count > 1")
    roots = nodes.groupBy("graph_id").agg(F.count_if("is_root").alias("n")).where("n <> 1")
    starts, ends = (nodes.select("graph_id", F.col("id").alias(end)) for end in ("src", "dst"))
    plain = edges.select("graph_id", "src", "dst")
    loose = plain.join(starts, ["graph_id", "src"], "left_anti").unionByName(plain.join(starts, ["graph_id", "src"], "left_semi").join(ends, ["graph_id", "dst"], "left_anti"))
    range_ = edges.where(~F.col("confidence").between(0, 1) | (F.col("src") == F.col("dst")))
    return violations({"node_ids": twice, "edge_ids": repeated, "one_root": roots, "endpoints": loose, "values": range_})


def strong_descendants(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return reachable(seeds, edges.where(F.col("relation").isin(*STRONG)).select("src", "dst"))
