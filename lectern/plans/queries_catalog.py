"""Queries of catalog filters, orders, gates, contracts and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import records
from lectern.operators import catalog, windows
from lectern.plans.registry import query
from lectern.plans.storage import parts_of
from lectern.plans.views import EDGES_SQL, PAPERS_SQL, edges, nodes, papers, table


@query("P04 P06 P07", f"""WITH {PAPERS_SQL}, p AS (SELECT ord, lower(title || ' ' || source || ' ' || category) AS hay, title, source, category, abstract, CASE WHEN ord % 9 <> 0 THEN CAST(substr(published_date, 1, 4) AS INTEGER) END AS y, ord % 2 = 0 AS oral FROM papers)
SELECT ord, oral AND category IN ('en', 'de') AND trim(coalesce(abstract, '')) <> '' AND (contains(hay, 'edges') OR contains(hay, 'edge') OR contains(hay, 'edg')) AND contains(hay, 'th') AS shown, coalesce(y BETWEEN 2019 AND 2021, true) AS in_years, contains(lower(title), 'sour') OR contains(lower(coalesce(source, '')), 'sour') OR contains(lower(category), 'sour') AS found FROM p""")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets and terms of the catalog, the year range and the text filter of a theme's nodes."""
    p = papers(spark, sf_dir).select("ord", "title", "source", "category", "abstract", F.when(F.col("ord") % 9 != 0, F.substring("published_date", 1, 4).cast("int")).alias("y"))
    hay = F.concat_ws(" ", "title", "source", "category")
    shown = catalog.facet_filter(F.when(F.col("ord") % 2 == 0, "Oral").otherwise("Poster"), F.array("category"), F.col("abstract"), hay, "Oral", ["en", "de"], True, ["edges", "th"])
    return p.select("ord", shown.alias("shown"), catalog.in_years(F.col("y"), 2019, 2021).alias("in_years"), catalog.node_matches(F.col("title"), F.col("source"), F.array("category"), "Sour").alias("found"))


@query("W02 W12", """WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS relevance, o_totalprice AS total, o_orderdate AS dated FROM orders)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN relevance IS NULL THEN 1 ELSE 0 END, relevance DESC, total DESC, o_orderkey) AS reranked, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(total / 100000) DESC, dated DESC, o_orderkey) AS fed FROM r""")
def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows first, by relevance, then total; and the feed: citations, date, id."""
    relevance = F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 1, 1).cast("int"))
    judged = Window.partitionBy("o_custkey").orderBy(F.when(relevance.isNull(), 1).otherwise(0), F.desc(relevance), F.desc("o_totalprice"), "o_orderkey")
    fed = Window.partitionBy("o_custkey").orderBy(F.desc(F.floor(F.col("o_totalprice") / 100000)), F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(judged).alias("reranked"), F.row_number().over(fed).alias("fed"))


@query("W13 W14 P20 P25", f"""WITH {EDGES_SQL}, t AS (SELECT graph_id, count(*) AS papers, max(yr) AS newest, CASE WHEN count(*) >= 12 THEN 0 WHEN count(*) >= 8 THEN 1 ELSE 2 END AS tier, CASE WHEN avg(CASE WHEN status = 'P' THEN 1.0 ELSE 0.0 END) < 0.05 THEN 0 ELSE 1 END AS quality FROM o GROUP BY graph_id),
e AS (SELECT graph_id, count(*) AS edges FROM edges GROUP BY graph_id), s AS (SELECT t.graph_id, c_nationkey AS shelf, papers, newest, tier, quality, edges FROM t JOIN e USING (graph_id) JOIN customer ON c_custkey = graph_id WHERE tier < 2)
SELECT shelf, graph_id, row_number() OVER (PARTITION BY shelf ORDER BY CASE WHEN newest >= 1998 THEN 0 ELSE 1 END, tier, quality, newest DESC, graph_id) AS pos, row_number() OVER (PARTITION BY shelf ORDER BY tier, edges DESC, papers DESC, newest DESC, graph_id) = 1 AS is_default FROM s""")
def gallery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of a published tier with a graph: current ones first, by publication tier, quality and date; and the default."""
    n = F.count("*")
    themes = nodes(spark, sf_dir).groupBy("graph_id").agg(
        n.alias("papers"), F.max("yr").alias("newest"), F.when(n >= 12, 0).when(n >= 8, 1).otherwise(2).alias("tier"), F.when(F.avg(F.when(F.col("status") == "P", 1.0).otherwise(0.0)) < 0.05, 0).otherwise(1).alias("quality")).where("tier < 2")
    linked = themes.join(edges(spark, sf_dir).groupBy("graph_id").agg(n.alias("edges")), "graph_id")
    shelved = linked.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_nationkey").alias("shelf")), "graph_id")
    order = Window.partitionBy("shelf").orderBy(F.when(F.col("newest") >= 1998, 0).otherwise(1), "tier", "quality", F.desc("newest"), "graph_id")
    first = Window.partitionBy("shelf").orderBy("tier", F.desc("edges"), F.desc("papers"), F.desc("newest"), "graph_id")
    return shelved.select("shelf", "graph_id", F.row_number().over(order).alias("pos"), (F.row_number().over(first) == 1).alias("is_default"))


@query("W16", f"""WITH {EDGES_SQL}, d AS (SELECT id, count(*) AS degree, count(*) FILTER (WHERE relation <> 'baseline_only') AS topical FROM (SELECT unnest([src, dst]) AS id, relation FROM edges) GROUP BY id)
SELECT graph_id, id AS root, coalesce(topical, 0) AS topical FROM o LEFT JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY priority = '1-URGENT' DESC, coalesce(topical, 0) DESC, coalesce(degree, 0) DESC, id) = 1""")
def topical_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By root rank, topical degree, degree, then the smallest id."""
    ends = edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("id"), "relation")
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"), F.count_if(F.col("relation") != "baseline_only").alias("topical"))
    every = nodes(spark, sf_dir).join(degree, "id", "left").withColumns({"topical": F.coalesce("topical", F.lit(0)), "degree": F.coalesce("degree", F.lit(0))})
    return windows.first_by(every, ["graph_id"], [F.desc(F.col("priority") == "1-URGENT"), F.desc("topical"), F.desc("degree"), F.asc("id")]).select("graph_id", F.col("id").alias("root"), "topical")


@query("G03", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c)
SELECT source, list(lang ORDER BY k) FILTER (WHERE k <= 2) AS head, CAST(coalesce(sum(n) FILTER (WHERE k > 2), 0) AS BIGINT) AS rest FROM r GROUP BY source""")
def tag_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return catalog.chips(counts, "source", "lang", "n", 2)


@query("G05", f"""WITH {EDGES_SQL}, k AS (SELECT graph_id % 20 AS g, src, dst % 40 AS dst, CASE WHEN dst % 17 = 0 THEN src_year + 3 ELSE src_year END AS src_year, dst_year, gap = 2 AND src % 5 = 0 AS evidence,
  CASE WHEN dst % 6 = 0 THEN ' B only follows A. ' WHEN dst % 7 = 0 THEN 'see A' WHEN dst % 11 <> 0 THEN 'B extends A to ' || dst END AS why FROM edges),
s AS (SELECT g, count(*) FILTER (WHERE n >= 8) AS sinks FROM (SELECT g, dst, count(*) AS n FROM k WHERE NOT evidence GROUP BY ALL) GROUP BY g)
SELECT g, count(*) AS edges, count(*) FILTER (WHERE trim(why) = 'B only follows A.') AS template, round(avg(CASE WHEN trim(why) = 'B only follows A.' THEN 1.0 ELSE 0.0 END), 6) AS template_ratio, count(*) FILTER (WHERE length(trim(why)) BETWEEN 1 AND 9) AS short,
  round(avg(CASE WHEN length(trim(why)) BETWEEN 1 AND 9 THEN 1.0 ELSE 0.0 END), 6) AS short_ratio, count(*) FILTER (WHERE src_year > dst_year + 1) AS reversals, coalesce(any_value(sinks), 0) AS sinks FROM k LEFT JOIN s USING (g) GROUP BY g""")
def theme_edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of many customers' orders laid over one another, so that some nodes have many citers."""
    c = F.col
    why = F.when(c("dst") % 6 == 0, " B only follows A. ").when(c("dst") % 7 == 0, "see A").when(c("dst") % 11 != 0, F.concat(F.lit("B extends A to "), "dst"))
    laid = edges(spark, sf_dir).select(
        (c("graph_id") % 20).alias("g"), "src", (c("dst") % 40).alias("dst"), F.when(c("dst") % 17 == 0, c("src_year") + 3).otherwise(c("src_year")).alias("src_year"), "dst_year", ((c("gap") == 2) & (c("src") % 5 == 0)).alias("evidence"), why.alias("rationale"))
    told = catalog.edge_metrics(laid, "g", ["B only follows A."])
    return told.withColumns({n: F.round(n, 6) for n in ("template_ratio", "short_ratio")})


@query("G06", """WITH n AS (SELECT o_custkey AS g, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 2 AS focus, o_totalprice > 400000 AS base, o_orderpriority < '4' AS topic FROM orders), j AS (SELECT * FROM n WHERE NOT focus AND NOT base)
SELECT g, round(avg(CASE WHEN topic THEN 0.0 ELSE 1.0 END), 6) AS share, coalesce(list_sort(list_slice(list_sort(list(id) FILTER (WHERE NOT topic)), 1, 5)), []) AS samples FROM j GROUP BY g""")
def off_topic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = nodes(spark, sf_dir).select(F.col("graph_id").alias("g"), "id", (F.col("rn") <= 2).alias("is_focus"), (F.col("price") > 400000).alias("foundational"), (F.col("priority") < "4").alias("on_topic"))
    return catalog.off_topic_share(every, "g").select("g", F.round("share", 6).alias("share"), "samples")


@query("G28 G29", f"""WITH {EDGES_SQL}, h AS (SELECT * FROM edges WHERE relation IN ('contrasts', 'baseline_only')), s AS (SELECT src AS id, 0 AS parent, count(*) AS child FROM h GROUP BY src UNION ALL SELECT dst, count(*), 0 FROM h GROUP BY dst)
SELECT id, CAST(sum(parent) AS BIGINT) AS parent, CAST(sum(child) AS BIGINT) AS child FROM s GROUP BY id""")
def hidden_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node the parents and children behind relations that are not shown."""
    hidden = edges(spark, sf_dir).where(F.col("relation").isin("contrasts", "baseline_only"))
    sides = hidden.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("parent"), F.lit(1).alias("child")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("parent"), F.lit(0).alias("child")))).alias("s")).select("s.*")
    return sides.groupBy("id").agg(F.sum("parent").alias("parent"), F.sum("child").alias("child"))


@query("G31", """WITH a AS (SELECT o_custkey AS theme, CASE WHEN o_orderkey % 3 = 0 THEN 'wrong' WHEN o_orderkey % 3 = 1 THEN '' END AS human, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'wrong' ELSE 'right' END AS suggested, o_orderstatus = 'F' AS sampled, o_totalprice < 100000 AS off FROM orders),
v AS (SELECT *, coalesce(NULLIF(human, ''), suggested) AS verdict FROM a) SELECT theme, count(*) FILTER (WHERE verdict IS NULL) AS unset, count(*) FILTER (WHERE verdict = 'wrong') AS wrong, round(count(*) FILTER (WHERE sampled AND off) * 1.0 / greatest(count(*) FILTER (WHERE sampled), 1), 6) AS off_topic_rate FROM v GROUP BY theme""")
def audit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("theme"), F.when(k % 3 == 0, "wrong").when(k % 3 == 1, "").alias("human"), F.when(p == "5-LOW", None).when(p == "4-NOT SPECIFIED", "wrong").otherwise("right").alias("suggested"),
        (F.col("o_orderstatus") == "F").alias("sampled"), (F.col("o_totalprice") < 100000).alias("off_topic"))
    return catalog.audit_outcome(rows, "theme").select("theme", "unset", "wrong", F.round("off_topic_rate", 6).alias("off_topic_rate"))


@query("P12 P24", """WITH s AS (SELECT l_orderkey, max(l_extendedprice) FILTER (WHERE l_linenumber = 1) AS seed FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN s USING (l_orderkey) WHERE NOT (l_partkey % 97 = 0 OR (coalesce(l_extendedprice > 2 * seed, false) AND l_returnflag <> 'R')) AND (l_linestatus = 'F' OR l_suppkey % 2 = 0)""")
def on_topic_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that are neither denied nor far more cited than the seeds (an order's first lines), and in the seeds' field."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    seeds = lines.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice"))).alias("seed"))
    intent, subfield = F.when(F.col("l_returnflag") == "R", "methodology"), F.when(F.col("l_linestatus") != "F", F.col("l_suppkey") % 2)
    both = lines.join(seeds, "l_orderkey").where(~catalog.off_topic(F.col("l_partkey") % 97 == 0, F.col("l_extendedprice"), F.col("seed"), intent) & catalog.in_scope(F.lit(0), subfield))
    return both.select("l_orderkey", "l_linenumber", "l_partkey")


@query("P18", """WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS cited FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1), n AS (SELECT max(o_orderdate) AS now FROM orders),
x AS (SELECT o_orderkey, cited, o_orderdate, o_custkey || ':' || o_orderpriority AS title FROM orders JOIN c ON l_orderkey = o_orderkey, n WHERE o_orderstatus IN ('O', 'P') AND o_orderdate > now - INTERVAL 730 DAY AND cited >= 2 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
SELECT o_orderkey, cited FROM x QUALIFY row_number() OVER (PARTITION BY title ORDER BY cited DESC, o_orderdate DESC, o_orderkey) = 1""")
def feed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent works of allowed types outside the graph that cite two of its nodes; of one title the best stays."""
    theme = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    cited = table(spark, sf_dir, "lineitem").join(theme, "l_partkey", "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("cited")).where("cited >= 2")
    orders = table(spark, sf_dir, "orders")
    now = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 730 DAY")).alias("since"))
    inside = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    recent = orders.where(F.col("o_orderstatus").isin("O", "P")).join(F.broadcast(now), F.col("o_orderdate") > F.col("since")).join(inside, "o_custkey", "left_anti").join(cited, "o_orderkey")
    titled = recent.withColumn("title", F.concat_ws(":", "o_custkey", "o_orderpriority"))
    return windows.first_by(titled, ["title"], [F.desc("cited"), F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey", "cited")


@query("J13 R29", """WITH k AS (SELECT l_partkey AS node, l_suppkey AS slug, 'a:' || l_partkey % 500 AS k FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, 'd:' || l_partkey FROM lineitem), q AS (SELECT p_partkey, unnest(['a:' || p_partkey, 'd:' || p_partkey]) AS k FROM part WHERE p_brand = 'Brand#3') SELECT DISTINCT p_partkey, slug, node FROM q JOIN k USING (k)""")
def paper_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes and nodes that hold a paper under any of its identifiers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("slug")).distinct()
    held = lines.select("node", "slug", F.explode(F.array(F.concat(F.lit("a:"), F.col("node") % 500), F.concat(F.lit("d:"), F.col("node")))).alias("k"))
    asked = table(spark, sf_dir, "part").where("p_brand = 'Brand#3'").select("p_partkey", F.explode(F.array(F.concat(F.lit("a:"), F.col("p_partkey")), F.concat(F.lit("d:"), F.col("p_partkey")))).alias("k"))
    return asked.join(held, "k").select("p_partkey", "slug", "node").distinct()


@query("U04", """WITH b AS (SELECT doc_id, lang = 'en' AS oral, sha256(text) AS c FROM documents WHERE doc_id % 10 <> 3), a AS (SELECT doc_id, lang = 'en' AS oral, CASE WHEN doc_id % 4 = 0 THEN 'same' ELSE sha256(text) END AS c FROM documents WHERE doc_id % 7 <> 2),
x AS (SELECT (SELECT count(*) FROM b) AS rows_before, (SELECT count(*) FROM b WHERE oral) AS orals_before, (SELECT count(DISTINCT c) FROM b) AS contents_before, (SELECT count(*) FROM a) AS rows_after, (SELECT count(*) FROM a WHERE oral) AS orals_after, (SELECT count(DISTINCT c) FROM a) AS contents_after, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) AS lost)
SELECT *, rows_after < rows_before * 0.9 OR orals_after < orals_before * 0.9 OR contents_after < contents_before * 0.9 OR lost > 0 AS refused FROM x""")
def catalog_shrink_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.sha2(F.col("text").cast("binary"), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", content.alias("content"))
    after = docs.where("doc_id % 7 <> 2").withColumn("content", F.when(F.col("doc_id") % 4 == 0, "same").otherwise(F.col("content")))
    return catalog.catalog_gate(docs.where("doc_id % 10 <> 3"), after, "doc_id", F.col("lang") == "en", 0.9)


@query("U05", f"""WITH {EDGES_SQL}, b AS (SELECT 'node' AS kind, CAST(id AS VARCHAR) AS item FROM o UNION SELECT 'focus', CAST(id AS VARCHAR) FROM o WHERE rn <= 2 UNION SELECT 'edge', src || '>' || dst FROM edges), a AS (SELECT 'node' AS kind, CAST(id AS VARCHAR) AS item FROM o WHERE id % 9 <> 0 UNION SELECT 'focus', CAST(id AS VARCHAR) FROM o WHERE rn <= 3 AND id % 9 <> 0 UNION SELECT 'edge', src || '>' || dst FROM edges WHERE src % 9 <> 0 AND dst % 9 <> 0)
SELECT coalesce(a.kind, b.kind) AS kind, count(*) FILTER (WHERE a.item IS NULL) AS lost, count(*) FILTER (WHERE b.item IS NULL) AS gained FROM b FULL JOIN a USING (kind, item) GROUP BY 1""")
def expansion_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus papers, nodes and edges that an expansion would lose."""
    every, links = nodes(spark, sf_dir), edges(spark, sf_dir)

    def items(n: DataFrame, e: DataFrame, focus: int) -> DataFrame:
        ids = F.struct(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")).alias("item")
        return n.select(F.lit("node").alias("kind"), ids).unionByName(n.where(F.col("rn") <= focus).select(F.lit("focus").alias("kind"), ids)).unionByName(e.select(F.lit("edge").alias("kind"), F.struct("src", "dst").alias("item")))

    after = items(every.where("id % 9 <> 0"), links.where("src % 9 <> 0 and dst % 9 <> 0"), 3)
    parts = parts_of(6 * table(spark, sf_dir, "orders").count())
    return catalog.set_losses(items(every, links, 2), after, ["focus", "node", "edge"], parts)


@query("U08 U09", f"""WITH {EDGES_SQL}, c AS (SELECT src, dst, CASE WHEN src % 6 = 0 THEN 'This work builds on ' || src ELSE 'uses the loss of ' || src END AS rationale FROM edges), live AS (SELECT id FROM o WHERE status <> 'P')
SELECT src, dst FROM c WHERE src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live) AND NOT regexp_matches(rationale, '^This work builds on [0-9]+$')""")
def kept_cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached relations between live works whose rationale is no template's."""
    s = F.col("src")
    cache = edges(spark, sf_dir).select("src", "dst", F.when(s % 6 == 0, F.concat(F.lit("This work builds on "), s)).otherwise(F.concat(F.lit("uses the loss of "), s)).alias("rationale"))
    live = nodes(spark, sf_dir).where("status <> 'P'").select("id")
    return catalog.purged(catalog.compacted(cache, live), ["^This work builds on [0-9]+$"]).select("src", "dst")


@query("V13", """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'changed' END AS state FROM documents WHERE doc_id % 13 = 0 OR doc_id % 17 = 0 UNION ALL SELECT -1, 'left_over'""")
def stale_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index against one that is computed again, row by row."""
    fresh = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    stored = fresh.where("doc_id % 13 <> 0").withColumn("lang", F.when(F.col("doc_id") % 17 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")))
    gone = fresh.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), "lang", "source")
    return catalog.stale(stored.unionByName(gone), fresh, "doc_id")


@query("V08", """WITH b AS (SELECT o_custkey AS theme, count(*) AS nodes, CASE WHEN count(*) >= 12 THEN 'audited' WHEN count(*) >= 8 THEN 'unaudited' ELSE 'blocked' END AS tier FROM orders GROUP BY 1), a AS (SELECT o_custkey AS theme, count(*) AS nodes, CASE WHEN count(*) >= 12 THEN 'audited' WHEN count(*) >= 8 THEN 'unaudited' ELSE 'blocked' END AS tier FROM orders WHERE o_orderstatus <> CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'P' END GROUP BY 1),
r AS (SELECT theme, CASE WHEN a.nodes IS NULL THEN 'gone' WHEN list_position(['audited', 'unaudited', 'blocked'], a.tier) > list_position(['audited', 'unaudited', 'blocked'], b.tier) THEN 'tier' WHEN a.nodes * 2 < b.nodes THEN 'nodes' END AS reason FROM b LEFT JOIN a USING (theme)) SELECT * FROM r WHERE reason IS NOT NULL""")
def publish_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes whose new build is of a lower tier, has under half of the nodes, or is gone."""
    orders = table(spark, sf_dir, "orders")

    def built(df: DataFrame) -> DataFrame:
        n = F.count("*")
        return df.groupBy(F.col("o_custkey").alias("theme")).agg(n.alias("nodes"), F.when(n >= 12, "audited").when(n >= 8, "unaudited").otherwise("blocked").alias("tier"))

    after = orders.where(F.col("o_orderstatus") != F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("P"))
    return catalog.regressions(built(orders), built(after), "theme", ["audited", "unaudited", "blocked"])


@query("V05", f"""WITH {PAPERS_SQL}, p AS (SELECT *, CASE WHEN ord % 29 = 0 THEN '-' || source ELSE source END AS conf FROM papers), w AS (SELECT *, row_number() OVER (ORDER BY conf, title, ord) - 1 AS place FROM p),
x AS (SELECT *, place + CASE WHEN ord % 31 = 0 THEN 1000000 ELSE 0 END AS told, CASE WHEN ord % 23 = 0 THEN 1800 WHEN ord % 19 = 0 THEN 2200 WHEN ord % 5 = 0 THEN NULL ELSE 2020 END AS y FROM w),
q AS (SELECT *, row_number() OVER (ORDER BY conf, title, told) - 1 AS seen FROM x), f AS (SELECT told AS ordinal, list_filter([CASE WHEN trim(coalesce(title, '')) = '' THEN 'title' END, CASE WHEN NOT regexp_full_match(conf, '[a-z0-9][a-z0-9-]*') THEN 'conference' END, CASE WHEN told <> seen THEN 'ordinal' END,
  CASE WHEN ord % 37 = 0 THEN 'authors' END, CASE WHEN ord % 41 = 0 THEN 'tags' END, CASE WHEN NOT coalesce(y BETWEEN 1900 AND 2200, true) THEN 'year' END, CASE WHEN category = 'es' THEN 'type' END], lambda s: s IS NOT NULL) AS faults FROM q)
SELECT * FROM f WHERE len(faults) > 0""")
def index_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the search index that break its contract; some are told wrong slugs, places, lists, years and types here."""
    from lectern.operators.ordinals import sorted_ordinal

    k = F.col("ord")
    conference = F.when(k % 29 == 0, F.concat(F.lit("-"), "source")).otherwise(F.col("source"))
    placed = sorted_ordinal(papers(spark, sf_dir).select("ord", "title", conference.alias("conference"), "category"), ["conference", "title", "ord"])
    rows = placed.select(
        "title", "conference", (F.col("ordinal") + F.when(k % 31 == 0, 1000000).otherwise(0)).alias("ordinal"), F.when(k % 37 != 0, F.array("category")).alias("authors"), F.array(F.when(k % 41 != 0, F.col("category"))).alias("tags"),
        F.when(k % 23 == 0, 1800).when(k % 19 == 0, 2200).when(k % 5 != 0, 2020).alias("year"), F.when(F.col("category") == "es", "Talk").otherwise("Oral").alias("type"))
    return catalog.index_faults(rows)


@query("V10", """WITH p AS (SELECT strlen(text) AS bytes, row_number() OVER (ORDER BY source, doc_id) - 1 AS k FROM documents), g AS (SELECT CAST(floor(k / 300) AS BIGINT) AS page, count(*) AS n, sum(bytes) AS bytes FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(max(bytes) AS BIGINT) AS worst, sum(n) <= 60000 AND max(bytes) <= 3145728 AS within FROM g""")
def page_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most sixty thousand rows, and no page of three hundred above three megabytes."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    worst = catalog.worst_page(docs, ["source", "doc_id"], F.col("bytes"), 300)
    return worst.select("rows", "worst", ((F.col("rows") <= 60000) & (F.col("worst") <= 3 << 20)).alias("within"))


@query("R19 R20 R21 P22", """WITH c AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) WHERE label = 3 GROUP BY i), q AS (SELECT list(m ORDER BY i) AS v FROM c),
d AS (SELECT vec_id, label, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * v[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))) AS cos FROM embeddings, q), s AS (SELECT avg(cos) AS m, stddev_pop(cos) AS sd, count(*) AS n FROM d),
z AS (SELECT vec_id, round(CASE WHEN n >= 2 AND sd > 1e-9 THEN (cos - m) / sd ELSE 0 END, 3) AS z, p_name, p_type FROM d JOIN part ON p_partkey = vec_id, s), r AS (SELECT *, CASE WHEN contains(lower(p_name), 'widget') AND starts_with(lower(p_name), 'red') THEN 'subject' WHEN contains(lower(p_name), 'widget') THEN 'component' WHEN contains(lower(p_type), 'promo') THEN 'abstract' ELSE 'none' END AS role FROM z)
SELECT vec_id, z, role, CASE WHEN role <> 'none' AND z >= 0 THEN 'topic' WHEN z >= CASE WHEN role = 'component' THEN 1.25 ELSE 1.0 END THEN 'topic' WHEN role = 'subject' THEN 'provisional' ELSE 'out' END AS verdict FROM r""")
def gated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the role of the theme's terms in their titles and by their relevance among all: a term and z of 0, or
    z of 1 (a quarter more for a component's title); a subject's title alone is provisional."""
    from lectern.functions.scores import cosine
    from lectern.operators.relevance import centroid, z_scores

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    scored = vectors.crossJoin(F.broadcast(centroid(vectors.where("label = 3"), "embedding"))).select("vec_id", cosine(F.col("embedding"), F.col("centroid")).alias("cos"))
    titled = z_scores(scored, "cos").select(F.col("vec_id").alias("p_partkey"), F.round("z", 3).alias("z")).join(table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("t"), F.lower("p_type").alias("a")), "p_partkey")
    z, named = F.col("z"), F.contains("t", F.lit("widget"))
    role = F.when(named & F.startswith("t", F.lit("red")), "subject").when(named, "component").when(F.contains("a", F.lit("promo")), "abstract").otherwise("none")
    verdict = F.when((F.col("role") != "none") & (z >= 0), "topic").when(z >= F.when(F.col("role") == "component", 1.25).otherwise(1.0), "topic").when(F.col("role") == "subject", "provisional").otherwise("out")
    return titled.select(F.col("p_partkey").alias("vec_id"), "z", role.alias("role")).select("vec_id", "z", "role", verdict.alias("verdict"))


@query("F62 F59 F43 F48", """SELECT p_partkey, 'On ' || p_name || ' and α-nets' AS tidy, CASE p_partkey % 3 WHEN 0 THEN 'lee' WHEN 1 THEN 'lee and yu' ELSE 'lee et al.' END AS credit, 'lee' || 1990 + p_size % 10 || lower(string_split(p_name, ' ')[1]) AS key, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE p_size END AS bucket FROM part""")
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without LaTeX, author credits, citation keys and venue tiers as they are shown."""
    from lectern.functions import text

    k, size = F.col("p_partkey"), F.col("p_size")
    title = F.concat(F.lit(r"On \\emph{"), F.col("p_name"), F.lit(r"} and $\\alpha$-nets").cast("string"))
    names = F.slice(F.array(F.lit("Ann Lee"), F.lit("Bo Yu"), F.lit("C D")), F.lit(1), (k % 3 + 1).cast("int"))
    rank = F.when(size % 4 == 0, "A+").when(size % 4 == 1, "a").when(size % 4 == 2, "preprint").otherwise(size.cast("string"))
    return table(spark, sf_dir, "part").select(k, records.tidy_latex(F.replace(title, F.lit("\\\\"), F.lit("\\"))).alias("tidy"), text.author_credit(names).alias("credit"), text.bibtex_key(F.lit("Ann Lee"), 1990 + size % 10, F.col("p_name")).alias("key"), records.tier_bucket(rank).alias("bucket"))
