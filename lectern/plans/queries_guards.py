"""Queries of the guards that a theme's graph passes: weak entries and the topic gate run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import fixpoint
from lectern.plans.registry import query
from lectern.plans.views import EDGES_SQL, edges, nodes


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of their customer's graph: the first is the seed, the price gives the embedding's score."""
    c = F.col
    return nodes(spark, sf_dir).select(
        "graph_id", c("id").alias("node"), (c("rn") == 1).alias("seed"), (c("priority") != "5-LOW").alias("admitted"), (c("priority") == "4-NOT SPECIFIED").alias("support"),
        F.when(c("id") % 11 != 0, c("price") / 200_000).alias("z"), (c("status") == "F").alias("about"),
    )


def weak_entry_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    links = edges(spark, sf_dir).where("gap = 1 or src % 3 = 0").select("graph_id", "src", "dst", "relation", F.when(F.col("dst") % 4 == 0, "api_rules").otherwise("api_citation").alias("method"))
    return fixpoint.entry_kinds(_entries(spark, sf_dir), 0.9), links


@query("R03")
def weak_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a weak score that nothing corroborates, with the rule and round that drops them. A fixpoint inside a
    fixpoint is beyond SQL; tested against a plain walk."""
    return fixpoint.confirm_weak(*weak_entry_rows(spark, sf_dir)).select("graph_id", "node", "rule", F.round("z", 6).alias("z"), "round")


@query("R33", f"""WITH {EDGES_SQL}, n AS (SELECT graph_id, id AS node, rn <= 2 AS focus, CASE id % 4 WHEN 0 THEN 'subject' WHEN 1 THEN 'component' WHEN 2 THEN 'abstract' ELSE 'none' END AS role, id % 4 <> 3 AND id % 5 <> 0 AS on_topic, id % 7 = 0 AS dataset FROM o),
e AS (SELECT graph_id, src, dst FROM edges WHERE (src + dst) % 3 <> 0),
w AS (SELECT graph_id, src AS node, dst AS other, false AS cites FROM e UNION SELECT graph_id, dst, src, true FROM e),
f AS (SELECT w.graph_id, w.node, bool_or(cites) AS a, bool_or(NOT cites) AS b FROM w JOIN n ON n.graph_id = w.graph_id AND n.node = w.other AND n.focus GROUP BY ALL),
j AS (SELECT n.*, coalesce(a AND NOT b, false) AND NOT focus AS descends FROM n LEFT JOIN f USING (graph_id, node)),
j1 AS (SELECT *, CASE WHEN focus THEN 'focus(' || role || ')' WHEN descends THEN CASE WHEN role = 'subject' THEN 'topic(descendant)' END WHEN on_topic THEN 'topic' END AS first FROM j),
nb AS (SELECT DISTINCT graph_id, node, other FROM w),
s AS (SELECT nb.graph_id, nb.node, count(*) AS support FROM nb JOIN j1 ON j1.graph_id = nb.graph_id AND j1.node = nb.other AND NOT j1.focus AND j1.first IN ('topic', 'topic(descendant)') GROUP BY ALL),
g AS (SELECT j1.*, coalesce(support, 0) AS support, coalesce(first, CASE WHEN descends THEN CASE WHEN role <> 'none' AND support >= 2 THEN 'support(descendant)' END WHEN support >= 2 AND NOT dataset THEN 'support' END) AS admitted,
  CASE WHEN descends THEN 'descendant(' || role || ')' WHEN dataset THEN 'support(dataset)' ELSE 'support' END AS rule FROM j1 LEFT JOIN s USING (graph_id, node)),
l AS (SELECT DISTINCT nb.graph_id, nb.node FROM nb JOIN g ON g.graph_id = nb.graph_id AND g.node = nb.other AND g.admitted IS NOT NULL WHERE nb.node <> nb.other)
SELECT g.graph_id, g.node, admitted IS NOT NULL AND (focus OR l.node IS NOT NULL) AS kept, CASE WHEN admitted IS NULL THEN rule WHEN focus OR l.node IS NOT NULL THEN admitted ELSE 'edgeless' END AS reason, support FROM g LEFT JOIN l USING (graph_id, node)""")
def readmitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes of a built graph the topic gate keeps when it is run again, and the rule that turns the others away."""
    c = F.col
    role = F.when(c("id") % 4 == 0, "subject").when(c("id") % 4 == 1, "component").when(c("id") % 4 == 2, "abstract").otherwise("none")
    rows = nodes(spark, sf_dir).select("graph_id", c("id").alias("node"), (c("rn") <= 2).alias("focus"), role.alias("role"), ((c("id") % 4 != 3) & (c("id") % 5 != 0)).alias("on_topic"), (c("id") % 7 == 0).alias("dataset"))
    return fixpoint.readmit(rows, edges(spark, sf_dir).where("(src + dst) % 3 <> 0").select("graph_id", "src", "dst"), least_support=2)
