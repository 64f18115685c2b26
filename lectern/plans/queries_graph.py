"""Lineage graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import graph
from lectern.plans.registry import query
from lectern.plans.views import EDGES_SQL, edges, nodes, table


@query("R09", f"""WITH RECURSIVE {EDGES_SQL}, h(root, node, hop, chain) AS (SELECT DISTINCT src, dst, 1, [src, dst] FROM edges WHERE relation <> 'baseline_only' UNION SELECT h.root, e.dst, hop + 1, list_append(chain, e.dst) FROM h JOIN edges e ON e.src = h.node AND e.relation <> 'baseline_only' WHERE hop < 3),
m AS (SELECT root, node, min(hop) AS hop FROM h GROUP BY ALL) SELECT root, node, CAST(hop AS BIGINT) AS hop, min(chain) AS chain FROM h JOIN m USING (root, node, hop) GROUP BY ALL""")
def strong_hop_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = edges(spark, sf_dir).where("relation <> 'baseline_only'").select("src", "dst")
    return graph.hops(strong, 3)


@query("R01", f"""WITH RECURSIVE {EDGES_SQL}, seeds AS (SELECT graph_id, min(id) AS node FROM o GROUP BY graph_id),
l1 AS (SELECT s.graph_id, e.dst AS node FROM seeds s JOIN edges e ON e.graph_id = s.graph_id AND e.src = s.node QUALIFY row_number() OVER (PARTITION BY s.graph_id, e.src ORDER BY e.dst_year DESC, e.dst) <= 1),
l2 AS (SELECT s.graph_id, e.dst AS node FROM l1 s JOIN edges e ON e.graph_id = s.graph_id AND e.src = s.node QUALIFY row_number() OVER (PARTITION BY s.graph_id, e.src ORDER BY e.dst_year DESC, e.dst) <= 1)
SELECT graph_id, node, CAST(min(d) AS BIGINT) AS depth FROM (SELECT *, 0 AS d FROM seeds UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY graph_id, node""")
def bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = nodes(spark, sf_dir).groupBy("graph_id").agg(F.min("id").alias("node"))
    return graph.bounded_bfs(seeds, edges(spark, sf_dir), depth=2, width=1, order=[F.desc("dst_year"), F.asc("dst")])


@query("R06")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rounds over all graphs at once; tested against a plain version."""
    found = graph.pagerank(nodes(spark, sf_dir).select("graph_id", F.col("id").alias("node")), edges(spark, sf_dir), rounds=20)
    return found.select("node", F.round("rank", 6).alias("rank"))


@query("R07 R08")
def main_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search path counts along each small graph; its steps are sequential, so a graph is one group."""
    return graph.main_paths(edges(spark, sf_dir))


@query("R10")
def shortest_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = nodes(spark, sf_dir).groupBy("graph_id").agg(F.min_by("id", "rn").alias("first"), F.max_by("id", "rn").alias("last"))
    return graph.shortest_paths(edges(spark, sf_dir), ends)


@query("R11")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cut node of each customer's chain of orders."""
    return graph.families(edges(spark, sf_dir).where("gap = 1"))


@query("R04 R05", f"""WITH RECURSIVE {EDGES_SQL}, s AS (SELECT id FROM o WHERE priority = '1-URGENT'), r(node) AS (SELECT id FROM s UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node AND e.relation IN ('extends', 'supersedes'))
SELECT id AS node, graph_id FROM o WHERE id NOT IN (SELECT node FROM r)""")
def weak_entry_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that no chain of strong edges from an urgent node supports."""
    every = nodes(spark, sf_dir)
    strong = edges(spark, sf_dir).where("relation in ('extends', 'supersedes')").select("src", "dst")
    reached = graph.reachable(every.where("priority = '1-URGENT'").select(F.col("id").alias("node")), strong)
    return every.select(F.col("id").alias("node"), "graph_id").join(reached, "node", "left_anti")


_YEARS = range(1990, 2003)


def _genealogy_sql() -> str:
    lines = "SELECT CAST(NULL AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS BIGINT) AS x WHERE false"
    parts, laid = [f"l{_YEARS[0] - 1} AS ({lines})"], f"l{_YEARS[0] - 1}"
    for y in _YEARS:
        mean = f"SELECT dst AS node, avg(x) AS mean FROM (SELECT DISTINCT src, dst FROM edges) JOIN {laid} p ON p.node = src GROUP BY dst"
        line = f"SELECT o.id AS node, m.mean, row_number() OVER (PARTITION BY graph_id ORDER BY m.mean NULLS LAST, price DESC, o.id) - 1 AS x FROM o LEFT JOIN ({mean}) m ON m.node = o.id WHERE yr = {y}"
        parts.append(f"l{y} AS MATERIALIZED (SELECT * FROM {laid} UNION ALL {line})")
        laid = f"l{y}"
    return f"WITH {EDGES_SQL}, {', '.join(parts)} SELECT node, round(mean, 6) AS mean, x FROM {laid}"


@query("R15", _genealogy_sql())
def genealogy_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = graph.genealogy_order(nodes(spark, sf_dir).select("graph_id", F.col("id").alias("node"), "yr", F.col("price").alias("cites")), edges(spark, sf_dir))
    return laid.select("node", F.round("mean", 6).alias("mean"), "x")


@query("R14", f"""WITH {EDGES_SQL}, c AS (SELECT dst, count(*) FILTER (WHERE relation IN ('supersedes', 'contrasts')) AS d, count(*) FILTER (WHERE relation IN ('successor', 'extends', 'ablation')) AS i FROM edges GROUP BY dst)
SELECT id AS node, CASE WHEN coalesce(d, 0) > coalesce(i, 0) THEN 'disrupt' WHEN coalesce(i, 0) > coalesce(d, 0) THEN 'incremental' ELSE 'neutral' END AS mode FROM o LEFT JOIN c ON dst = id""")
def novelty_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a node's incoming relations disrupt its ancestors or go on from them."""
    relation = F.col("relation")
    counts = edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count_if(relation.isin("supersedes", "contrasts")).alias("d"), F.count_if(relation.isin("successor", "extends", "ablation")).alias("i"))
    d, i = F.coalesce("d", F.lit(0)), F.coalesce("i", F.lit(0))
    return nodes(spark, sf_dir).select("id").join(counts, "id", "left").select(F.col("id").alias("node"), F.when(d > i, "disrupt").when(i > d, "incremental").otherwise("neutral").alias("mode"))


@query("R24", """WITH o AS (SELECT o_orderkey AS id, o_custkey AS g, CAST(year(o_orderdate) AS BIGINT) AS y, o_totalprice AS c FROM orders)
SELECT id, 130.0 + 260 * (dense_rank() OVER (PARTITION BY g ORDER BY y) - 1) AS x, round(log10(c + 1), 6) AS height, row_number() OVER (PARTITION BY g, y ORDER BY c DESC, id) AS fan FROM o""")
def timeline_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each year, its centre as x; in it, height by citations and a fan by citations, then id."""
    fan = F.row_number().over(Window.partitionBy("graph_id", "yr").orderBy(F.desc("price"), "id"))
    column = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("yr"))
    return nodes(spark, sf_dir).select("id", (F.lit(130.0) + 260 * (column - 1)).alias("x"), F.round(F.log10(F.col("price") + 1), 6).alias("height"), fan.alias("fan"))


@query("R22", """WITH a AS (SELECT p_partkey, upper(string_agg(substr(w, 1, 1), '' ORDER BY i)) AS acronym FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY p_partkey)
SELECT acronym, count(*) AS papers FROM a GROUP BY acronym HAVING count(*) >= 2""")
def theme_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    initials = F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), ""))
    return table(spark, sf_dir, "part").groupBy(initials.alias("acronym")).agg(F.count("*").alias("papers")).where("papers >= 2")


@query("R30", f"""WITH {EDGES_SQL}, x AS (SELECT *, CASE WHEN relation = 'baseline_only' THEN 'relation' WHEN src_year > dst_year THEN 'order' WHEN gap > 1 THEN 'hop' ELSE 'shown' END AS reason FROM edges) SELECT reason, count(*) AS n FROM x GROUP BY reason""")
def focus_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("relation") == "baseline_only", "relation").when(F.col("src_year") > F.col("dst_year"), "order").when(F.col("gap") > 1, "hop").otherwise("shown")
    return edges(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("R31", f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT src, dst FROM edges WHERE src_year = dst_year), d(node, depth) AS (SELECT id, 0 FROM o UNION SELECT e.dst, depth + 1 FROM d JOIN e ON e.src = d.node WHERE depth < 40)
SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM d GROUP BY node""")
def same_year_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = nodes(spark, sf_dir).select(F.col("id").alias("node"))
    return graph.longest_depth(small, edges(spark, sf_dir).where("src_year = dst_year").select("src", "dst"))


@query("R18", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 450000 THEN 'young' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'event' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders WHERE o_totalprice > 450000 OR (o_orderpriority = '1-URGENT' AND o_totalprice > 300000)""")
def suspect_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    young, event = F.col("o_totalprice") > 450000, (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)
    reasons = F.array_join(F.array_compact(F.array(F.when(young, "young"), F.when(event, "event"))), ",")
    return table(spark, sf_dir, "orders").where(young | event).select("o_orderkey", reasons.alias("reasons"))


def _theme(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from lectern.operators import lineage

    papers = nodes(spark, sf_dir).select("graph_id", "id", F.col("yr").alias("year"), F.col("price").alias("impact"), (F.col("rn") <= 2).alias("is_focus"))
    links = edges(spark, sf_dir).select("graph_id", "src", "dst", "dst_year", "relation", F.concat(F.lit("cites "), F.col("src")).alias("rationale"))
    return lineage.build(papers, links, F.col("dst") % 11 == 0)


@query("R28 R02 R04 R05 P13 P14 W15", f"""WITH RECURSIVE {EDGES_SQL}, seeds AS (SELECT graph_id, id FROM o WHERE rn <= 2),
l1 AS (SELECT e.graph_id, e.dst AS id FROM seeds s JOIN edges e ON e.graph_id = s.graph_id AND e.src = s.id), l2 AS (SELECT e.graph_id, e.dst AS id FROM (SELECT DISTINCT * FROM l1) s JOIN edges e ON e.graph_id = s.graph_id AND e.src = s.id),
n AS (SELECT o.graph_id, o.id, yr, price, rn <= 2 AS focus FROM o WHERE id IN (SELECT id FROM seeds UNION SELECT id FROM l1 UNION SELECT id FROM l2)),
g AS (SELECT graph_id, src, dst, CASE WHEN dst % 11 = 0 THEN 'baseline_only' ELSE relation END AS relation FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) AND length('cites ' || src) >= 6),
n2 AS (SELECT * FROM n WHERE focus OR id IN (SELECT src FROM g UNION SELECT dst FROM g)),
g2 AS (SELECT * FROM g WHERE src IN (SELECT id FROM n2) AND dst IN (SELECT id FROM n2)),
n3 AS (SELECT n2.* FROM n2 LEFT JOIN (SELECT graph_id, min(yr) - 5 AS lim FROM n2 WHERE focus GROUP BY 1) m USING (graph_id) WHERE focus OR yr >= lim OR id IN (SELECT unnest([src, dst]) FROM g2 WHERE relation IN ('supersedes', 'successor', 'extends'))),
g3 AS (SELECT * FROM g2 WHERE src IN (SELECT id FROM n3) AND dst IN (SELECT id FROM n3)),
n4 AS (SELECT * FROM n3 WHERE focus OR price >= 100000 OR id IN (SELECT src FROM g3) OR id IN (SELECT dst FROM g3 WHERE relation IN ('supersedes', 'successor', 'extends'))),
g4 AS (SELECT * FROM g3 WHERE src IN (SELECT id FROM n4) AND dst IN (SELECT id FROM n4)),
d AS (SELECT id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS id FROM g4) GROUP BY id)
SELECT n4.graph_id, n4.id, coalesce(degree, 0) AS degree, focus AND row_number() OVER (PARTITION BY n4.graph_id ORDER BY focus DESC, coalesce(degree, 0) DESC, n4.id) = 1 AS is_root FROM n4 LEFT JOIN d ON d.id = n4.id WHERE focus OR degree > 0""")
def theme_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _theme(spark, sf_dir)[0].select("graph_id", "id", "degree", "is_root")


@query("R28", """SELECT * FROM (VALUES ('node_ids', 0::BIGINT), ('edge_ids', 0::BIGINT), ('one_root', 0::BIGINT), ('endpoints', 0::BIGINT), ('values', 0::BIGINT)) t(kind, violations)""")
def lineage_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators import lineage

    return lineage.contract(*_theme(spark, sf_dir))


@query("R27 R26 W10")
def edition_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best papers of each edition, their best references and citers, and the edges between."""
    ranked = Window.partitionBy("yr").orderBy(F.desc("price"), "id")
    seeds = nodes(spark, sf_dir).withColumn("r", F.row_number().over(ranked)).where("r <= 30").select("yr", F.col("id").alias("seed"))
    links = edges(spark, sf_dir).select("src", "dst", "relation", "src_year", "dst_year")
    def best(end: str, other: str, year: str) -> DataFrame:
        order = Window.partitionBy("yr", "seed").orderBy(F.desc(year), other)
        near = seeds.join(links.withColumnRenamed(end, "seed"), "seed").withColumn("r", F.row_number().over(order)).where("r <= 2")
        return near.select("yr", F.col("seed").alias(end), F.col(other), "relation").select("yr", "src", "dst", "relation")

    return best("src", "dst", "dst_year").unionByName(best("dst", "src", "src_year")).distinct()
