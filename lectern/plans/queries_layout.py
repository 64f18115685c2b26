"""Queries of drawn views: year lines and focused projections of each customer's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.plans.registry import query
from lectern.plans.views import edges, nodes


def drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    year = F.when(c("id") % 13 != 0, c("yr") - c("yr") % 4)
    return nodes(spark, sf_dir).select("graph_id", c("id").alias("node"), year.alias("year"), "price"), edges(spark, sf_dir).select("graph_id", "src", "dst", "relation")


@query("R25 R32")
def year_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of each graph in year bands, wrapped into lines of three below the same-year papers that they cite. Packing is
    greedy, so it is tested against a plain walk."""
    return layout.chronological(*drawn(spark, sf_dir), per_line=3, order=[F.desc("price"), F.asc("node")])


def claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Citations as claims, judged by their years and orders; the third paper of each graph is in focus."""
    c = F.col
    rows = edges(spark, sf_dir).select(
        "graph_id", (c("src") * 4 + c("gap")).alias("id"), "src", "dst", F.when((c("src") + c("dst")) % 9 != 0, "accepted").otherwise("rejected").alias("decision"),
        F.element_at(F.array(*map(F.lit, layout.TRUST)), (c("dst") % 3 + 1).cast("int")).alias("trust"), F.when(c("src") % 5 == 0, "comparison").otherwise("genealogy").alias("family"), "relation",
        F.when(c("src") % 7 != 0, (c("dst") % 100) / 100.0).alias("probability"), F.array(F.when(c("src") % 2 == 0, "refs").otherwise("pages")).alias("sources"), F.array(F.lit("quote")).alias("kinds"),
    )
    return rows, nodes(spark, sf_dir).where("rn = 3").select("graph_id", c("id").alias("node"), F.array(c("id")).alias("expanded"))


VIEW = layout.View(trust=layout.TRUST, relations=("supersedes", "extends", "contrasts"), sources=("refs",), least_confidence=0.2, hops=2, nodes=6, claims=5)


@query("R30")
def focus_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's place in its graph's focused view, or the first rule or budget that keeps it out."""
    return layout.focus_projection(*claims(spark, sf_dir), VIEW)
