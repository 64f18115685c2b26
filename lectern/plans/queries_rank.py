"""Scoring, filtering, ranking and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import scores, text
from lectern.operators import scoring, windows
from lectern.plans.registry import query
from lectern.plans.views import PAPERS_SQL, papers, table

KEYWORDS = ["the", "tion", "license", "der", "que", "worthless"]
_KEYWORD_SQL = " + ".join(f"CASE WHEN contains(regexp_replace(lower(abstract), '[-_/]+', ' ', 'g'), '{k}') THEN 1 ELSE 0 END" for k in KEYWORDS)


@query(
    "W01 F01 F02 P01 U01",
    f"""WITH {PAPERS_SQL},
s AS (SELECT uid, ord, title, least(({_KEYWORD_SQL}) / 3.0, 1.0) * 100 AS k, least(n_chars / 5000.0, 1.0) * 100 AS l, CAST(coalesce(quality, 0) AS DOUBLE) * 100 AS q
  FROM papers WHERE category IN ('en', 'de', 'fr') AND published_date >= '2019-01-01' AND NOT contains(lower(title || ' ' || abstract), 'moron'))
SELECT uid, title, round(0.5 * q + 0.3 * k + 0.2 * l, 6) AS score FROM s ORDER BY 0.5 * q + 0.3 * k + 0.2 * l DESC, ord LIMIT 30""",
)
def weighted_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scoring.rule_filter(papers(spark, sf_dir), ["en", "de", "fr"], "2019-01-01", ["moron"])
    scored = kept.select(
        "uid", "ord", "title", scores.keyword_score(scores.matched_keywords(F.col("abstract"), KEYWORDS)).alias("k"),
        scores.saturated(F.col("n_chars"), 5000.0).alias("l"), (F.coalesce("quality", F.lit(0)).cast("double") * 100).alias("q"),
    ).withColumn("score", scoring.weighted({"q": 0.5, "k": 0.3, "l": 0.2}))
    return scoring.top(scored, [F.desc("score"), F.asc("ord")], 30).select("uid", "title", F.round("score", 6).alias("score"))


@query(
    "P02 P03",
    """WITH last AS (SELECT max(ts) AS now FROM events), seen AS (SELECT DISTINCT user_id FROM events, last WHERE ts > now - INTERVAL 2 DAY)
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM seen WHERE user_id IS NOT NULL)""",
)
def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    limit = events.agg((F.max("ts") - F.expr("INTERVAL 2 DAY")).alias("since"))
    seen = events.join(F.broadcast(limit), F.col("ts") > F.col("since")).select(F.col("user_id").alias("c_custkey")).distinct()
    return scoring.unseen(table(spark, sf_dir, "customer"), seen, "c_custkey").select("c_custkey", "c_name")


@query(
    "F06 F07 F09 F10 F46 D20",
    """WITH c AS (SELECT p_partkey, count(l_orderkey) AS cites, min(l_shipdate) AS first FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT p_partkey, cites, round(least(cites / greatest(date_diff('day', least(first, TIMESTAMP '2001-01-01'), TIMESTAMP '2001-01-01'), 1) / 2.0, 1.0) * 100, 6) AS velocity,
  round(ln(least(cites, 10000) + 1.0) / ln(10001.0) * 100, 6) AS stars, round((cites + 1) / greatest(p_size / 10.0, 0.5) * CASE WHEN p_type = 'PROMO' THEN 0.3 ELSE 1.0 END, 6) AS seed,
  p_size / 10.0 <= 3 AND cites / greatest(p_size / 10.0, 0.5) >= 20 AS trending, CAST(least(floor(least(log10(cites + 1.0) / log10(500001.0), 1.0) * 6), 5) AS INTEGER) AS bucket
FROM c JOIN part USING (p_partkey)""",
)
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("cites"), F.min("l_shipdate").alias("first"))
    parts = table(spark, sf_dir, "part").join(cited, "p_partkey", "left").withColumn("cites", F.coalesce("cites", F.lit(0)))
    cites, age, today = F.col("cites"), F.col("p_size") / 10.0, F.lit("2001-01-01").cast("timestamp")
    return parts.select(
        "p_partkey", "cites", F.round(scores.velocity_score(cites, F.coalesce("first", today), today), 6).alias("velocity"), F.round(scores.stars_score(cites), 6).alias("stars"),
        F.round(scores.seed_score(cites, age, F.col("p_type") == "PROMO"), 6).alias("seed"), scores.is_trending(cites, age, rate=20.0).alias("trending"),
        scores.heat_bucket(scores.citation_heat(cites)).alias("bucket"),
    )


@query(
    "F03",
    """SELECT c_custkey, CASE upper(trim(c_mktsegment)) WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 0 END AS tier,
CASE upper(trim(c_mktsegment)) WHEN 'BUILDING' THEN 100 WHEN 'MACHINERY' THEN 100 WHEN 'AUTOMOBILE' THEN 80 WHEN 'HOUSEHOLD' THEN 60 ELSE 30 END AS venue_score,
CASE WHEN lower(c_name) = 'customer#000000007' THEN 100 WHEN contains(lower(n_name), 'nation_1') THEN 50 ELSE 0 END AS follow_score FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def venue_and_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    tier = scores.venue_tier(F.col("c_mktsegment"), [["building", "machinery"], ["automobile"], ["household"]])
    follow = F.when(F.lower("c_name") == "customer#000000007", 100).when(F.contains(F.lower("n_name"), F.lit("nation_1")), 50).otherwise(0)
    points = F.when(tier == 1, 100).when(tier == 2, 80).when(tier == 3, 60).otherwise(30)
    return rows.select("c_custkey", tier.alias("tier"), points.alias("venue_score"), follow.alias("follow_score"))


@query(
    "W03 P05 W04",
    f"""WITH {PAPERS_SQL}, r AS (SELECT ord, title, category, CASE WHEN lower(title) = 'the and of' THEN 0 WHEN contains(lower(title), 'the') THEN 1 WHEN contains(lower(source), 'the') THEN 2 ELSE 3 END AS rank,
  CAST(substr(published_date, 1, 4) AS INTEGER) AS yr FROM papers WHERE category = 'en' AND (contains(lower(title), 'the') OR contains(lower(abstract), 'thea')))
SELECT ord, title, rank, yr FROM r ORDER BY rank, yr DESC NULLS LAST, ord LIMIT 20 OFFSET 20""",
)
def facet_search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = papers(spark, sf_dir).where("category = 'en'").where(F.contains(F.lower("title"), F.lit("the")) | F.contains(F.lower("abstract"), F.lit("thea")))
    title = F.lower("title")
    rank = F.when(title == "the and of", 0).when(F.contains(title, F.lit("the")), 1).when(F.contains(F.lower("source"), F.lit("the")), 2).otherwise(3)
    ranked = found.select("ord", "title", rank.alias("rank"), F.substring("published_date", 1, 4).cast("int").alias("yr"))
    return windows.page(ranked, [F.asc("rank"), F.desc_nulls_last("yr"), F.asc("ord")], 2)


@query(
    "W05 W06 F40",
    """SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE 1 END, lower(regexp_replace(p_name, '^[^0-9A-Za-z]+', '')), p_partkey) AS pos FROM part QUALIFY pos <= 10""",
)
def catalog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("p_type").orderBy(F.when(F.col("p_brand") == "Brand#1", 0).otherwise(1), text.title_sort_key(F.col("p_name")), "p_partkey")
    return table(spark, sf_dir, "part").select("p_type", "p_partkey", F.row_number().over(order).alias("pos")).where("pos <= 10")


@query(
    "W07 W11",
    """SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS pos
FROM lineitem QUALIFY pos <= 3""",
)
def influential_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.when(F.col("l_returnflag") == "R", 1).otherwise(0), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey")]
    ranked = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*order)))
    return ranked.where("pos <= 3").select("l_partkey", "l_orderkey", "l_linenumber", "pos")


@query(
    "W08 W10",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END,
o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.5 ELSE 0.25 END DESC, o_orderkey LIMIT 300""",
)
def ranked_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).when(F.col("o_orderpriority") == "2-HIGH", 0.5).otherwise(0.25)
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp '1996-01-01'")
    return scoring.top(recent, [F.when(F.col("o_orderstatus") == "P", 1).otherwise(0), F.desc(F.col("o_totalprice") * weight), F.asc("o_orderkey")], 300).select("o_orderkey", "o_totalprice")


@query(
    "W15",
    """WITH d AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY l_orderkey), j AS (SELECT o_custkey, o_orderkey, coalesce(degree, 0) AS degree FROM orders LEFT JOIN d ON l_orderkey = o_orderkey)
SELECT o_custkey, o_orderkey AS root, degree FROM j QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY degree DESC, o_orderkey) = 1""",
)
def root_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("degree"))
    joined = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(degree, "o_orderkey", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = joined.groupBy("o_custkey").agg(F.max(F.struct("degree", (-F.col("o_orderkey")).alias("least"))).alias("b"))
    return best.select("o_custkey", (-F.col("b.least")).alias("root"), "b.degree")


@query(
    "W17 K07 K08",
    """WITH x AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS prefix FROM documents)
SELECT CAST(floor(ordinal / 256) AS BIGINT) AS block, prefix < '80' AS low_half, count(*) AS n, min(doc_id) AS first_id FROM x GROUP BY 1, 2""",
)
def id_block_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.ordinals import dense_ordinal

    numbered = dense_ordinal(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"])
    prefix = F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 2)
    return numbered.groupBy(F.floor(F.col("ordinal") / 256).alias("block"), (prefix < "80").alias("low_half")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "W18 R13",
    """WITH d AS (SELECT p_partkey, count(DISTINCT l_orderkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey), t AS (SELECT quantile_disc(degree, 0.9) AS p90, count(*) AS n FROM d WHERE degree > 0)
SELECT p_partkey, degree, degree >= greatest(p90, 4) AND n >= 5 AS hub, degree = 0 AS orphan FROM d, t""",
)
def hub_set_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("degree"))
    degrees = table(spark, sf_dir, "part").select("p_partkey").join(counts, "p_partkey", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    limit = degrees.where("degree > 0").agg(F.expr("percentile_disc(0.9) within group (order by degree)").cast("long").alias("p90"), F.count("*").alias("n"))
    return degrees.crossJoin(F.broadcast(limit)).select("p_partkey", "degree", ((F.col("degree") >= F.greatest("p90", F.lit(4))) & (F.col("n") >= 5)).alias("hub"), (F.col("degree") == 0).alias("orphan"))


@query(
    "X07 K10",
    """WITH b AS (SELECT p_partkey, regexp_replace(lower(list_last(string_split(trim(p_name), ' '))), '[^a-z0-9]', '', 'g') || CAST(1990 + p_size % 10 AS VARCHAR) AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS nth FROM b)
SELECT p_partkey, base || CASE WHEN nth = 1 THEN '' WHEN nth <= 27 THEN chr(CAST(95 + nth AS INTEGER)) ELSE CAST(nth AS VARCHAR) END AS key FROM n""",
)
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.regexp_replace(text.surname(F.col("p_name")), "[^a-z0-9]", ""), (F.lit(1990) + F.col("p_size") % 10).cast("string"))
    parts = table(spark, sf_dir, "part").select("p_partkey", base.alias("base"))
    return parts.select("p_partkey", F.concat("base", text.uniquifier(F.row_number().over(Window.partitionBy("base").orderBy("p_partkey")))).alias("key"))


@query(
    "F08 R23",
    """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) WHERE label = 3 GROUP BY label, i),
q AS (SELECT list(m ORDER BY i) AS v FROM c), d AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * v[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))) AS cos FROM embeddings, q),
s AS (SELECT avg(cos) AS m, stddev_pop(cos) AS sd, count(*) AS n FROM d)
SELECT vec_id, round(CASE WHEN n >= 2 AND sd > 1e-9 THEN (cos - m) / sd ELSE 0 END, 4) AS z, round(greatest(least((cos + 1) / 2 * 100, 100), 0), 4) AS score FROM d, s""",
)
def embedding_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.relevance import centroid, z_scores

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    scored = vectors.crossJoin(F.broadcast(centroid(vectors.where("label = 3"), "embedding"))).select("vec_id", scores.cosine(F.col("embedding"), F.col("centroid")).alias("cos"))
    return z_scores(scored, "cos").select("vec_id", F.round("z", 4).alias("z"), F.round(scores.similarity_score(F.col("cos")), 4).alias("score"))
