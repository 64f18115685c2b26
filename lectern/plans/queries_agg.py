"""Aggregates, quality checks, contracts and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.rules import any_of, first_rule
from lectern.operators import quality, windows
from lectern.plans.registry import query
from lectern.plans.views import EDGES_SQL, edges, table


@query("G02 G04 G03", """SELECT o_orderstatus AS type, count(*) AS n, grouping(o_orderstatus) AS is_total FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "type").rollup("type").agg(F.count("*").alias("n"), F.grouping("type").cast("long").alias("is_total"))


@query("G05", f"""WITH {EDGES_SQL} SELECT graph_id, count(*) AS edges, count(*) FILTER (WHERE src_year > dst_year + 1) AS reversals, count(*) FILTER (WHERE relation = 'baseline_only') AS weak,
round(avg(CASE WHEN relation = 'baseline_only' THEN 1.0 ELSE 0.0 END), 6) AS weak_ratio, count(*) FILTER (WHERE dst_year - src_year >= 2) AS late FROM edges GROUP BY graph_id""")
def edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    weak = F.col("relation") == "baseline_only"
    return edges(spark, sf_dir).groupBy("graph_id").agg(
        F.count("*").alias("edges"), F.count_if(F.col("src_year") > F.col("dst_year") + 1).alias("reversals"), F.count_if(weak).alias("weak"),
        F.round(F.avg(F.when(weak, 1.0).otherwise(0.0)), 6).alias("weak_ratio"), F.count_if(F.col("dst_year") - F.col("src_year") >= 2).alias("late"))


@query("R16", f"""WITH {EDGES_SQL}, g AS (SELECT src AS node, count(*) AS citers, count(*) FILTER (WHERE src_year - dst_year >= 2 OR src % 17 = 0) AS older, max(abs(src_year - dst_year)) AS gap FROM edges GROUP BY src)
SELECT node, citers, older FROM g WHERE older * 2 >= citers AND (older >= 2 OR gap >= 3)""")
def chronology_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("src_year") - F.col("dst_year")
    by = edges(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("citers"), F.count_if((gap >= 2) | (F.col("src") % 17 == 0)).alias("older"), F.max(F.abs(gap)).alias("gap"))
    return by.where("older * 2 >= citers and (older >= 2 or gap >= 3)").select("node", "citers", "older")


@query("G07 G08", """SELECT o_custkey AS theme, o_orderpriority AS method, count(*) AS n, grouping(o_custkey) AS total FROM orders GROUP BY GROUPING SETS ((o_custkey, o_orderpriority), (o_orderpriority), ())""")
def provenance_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("theme"), F.col("o_orderpriority").alias("method"))
    return rows.groupingSets([["theme", "method"], ["method"], []], "theme", "method").agg(F.count("*").alias("n"), F.grouping("theme").cast("long").alias("total")).select("theme", "method", "n", "total")


@query("G09 G10", """SELECT l_returnflag AS model, count(*) AS n, count(*) FILTER (WHERE l_discount < 0.03) AS short, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS rate,
round(count(*) FILTER (WHERE l_tax > 0.04) * 1.0 / greatest(count(*) FILTER (WHERE l_tax > 0.04 OR l_discount > 0.05), 1), 6) AS classified FROM lineitem GROUP BY l_returnflag""")
def cache_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, guessed = F.col("l_tax") > 0.04, F.col("l_discount") > 0.05
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") < 0.03).alias("short"), F.round(F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)), 6).alias("rate"),
        F.round(F.count_if(known) / F.greatest(F.count_if(known | guessed), F.lit(1)), 6).alias("classified"))


@query("G11 P24", """SELECT c_nationkey, c_mktsegment AS dominant, n FROM (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS known FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) WHERE known >= 3
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1""")
def dominant_mode_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.mode(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", least=3).select("c_nationkey", F.col("c_mktsegment").alias("dominant"), "n")


@query("G12 R02", """SELECT l_partkey, count(DISTINCT l_orderkey) AS support, max(p_retailprice) AS cites FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 3 ORDER BY support DESC, cites DESC, l_partkey LIMIT 100""")
def canonical_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("support")).where("support >= 3")
    cites = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("cites"))
    return support.join(cites, "l_partkey").orderBy(F.desc("support"), F.desc("cites"), "l_partkey").limit(100)


@query("G13 G23", """SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS BIGINT) AS fn,
round(count(*) FILTER (WHERE quality = 1 AND toxic = 0) * 1.0 / count(*) FILTER (WHERE quality = 1), 6) AS precision, round(count(*) FILTER (WHERE quality = 1 AND toxic = 0) * 1.0 / count(*) FILTER (WHERE toxic = 0), 6) AS recall FROM labels""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.precision_recall(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0).select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("G24", """WITH x AS (SELECT l_suppkey % 4 AS fold, l_extendedprice / 100000 AS score, l_returnflag = 'R' AS gold FROM lineitem), g AS (SELECT t / 10.0 AS t FROM range(1, 10) r(t)),
s AS (SELECT f.fold AS held, t, count(*) FILTER (WHERE gold AND score >= t) AS tp, count(*) FILTER (WHERE NOT gold AND score >= t) AS fp, count(*) FILTER (WHERE gold AND score < t) AS fn FROM (SELECT DISTINCT fold FROM x) f, g, x WHERE x.fold <> f.fold GROUP BY ALL)
SELECT held, CAST(t AS DOUBLE) AS threshold, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s QUALIFY row_number() OVER (PARTITION BY held ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, t DESC) = 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("fold"), (F.col("l_extendedprice") / 100000).alias("score"), (F.col("l_returnflag") == "R").alias("gold"))
    return quality.leave_one_out_threshold(x, [k / 10 for k in range(1, 10)]).select("held", "threshold", F.round("f1", 6).alias("f1"))


@query("G14 G15", """SELECT c_nationkey, coalesce(NULLIF(c_mktsegment, 'FURNITURE'), 'Other') AS kind, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL""")
def cluster_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")), F.lit("Other"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", kind.alias("kind")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("G16 K16 G32", """SELECT o_custkey AS theme, count(*) AS papers, CAST(min(year(o_orderdate)) AS BIGINT) AS low, CAST(max(year(o_orderdate)) AS BIGINT) AS high, bool_or(o_orderstatus = 'P') AS pending FROM orders GROUP BY o_custkey""")
def theme_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate").cast("long")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("theme")).agg(F.count("*").alias("papers"), F.min(year).alias("low"), F.max(year).alias("high"), F.bool_or(F.col("o_orderstatus") == "P").alias("pending"))


@query("G17 G18 G19", """WITH c AS (SELECT o_custkey AS theme, count(*) >= 6 AS enough, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) <= 0.5 AS settled, max(o_totalprice) > 400000 AS strong FROM orders GROUP BY o_custkey)
SELECT theme, CAST(CAST(enough AS INTEGER) + CAST(settled AS INTEGER) + CAST(strong AS INTEGER) AS BIGINT) AS passed, CASE WHEN enough AND settled THEN CASE WHEN strong THEN 'audited' ELSE 'unaudited' END ELSE 'blocked' END AS tier FROM c""")
def publication_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"enough": F.count("*") >= 6, "settled": F.avg(F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0)) <= 0.5, "strong": F.max("o_totalprice") > 400000}
    return quality.tiers(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "theme"), "theme", checks, golden="strong")


@query("G22", """SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS fingerprint FROM events WHERE event_type IN ('error', 'signup', 'click') GROUP BY user_id""")
def problem_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup", "click")).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("fingerprint"))


@query("G21", """SELECT (SELECT count(*) FROM lineitem) AS collected, (SELECT count(*) FROM lineitem WHERE l_quantity > 10) AS filtered, (SELECT count(*) FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.05) AS scored""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep, score = F.col("l_quantity") > 10, F.col("l_discount") > 0.05
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("collected"), F.count_if(keep).alias("filtered"), F.count_if(keep & score).alias("scored"))


@query("G25 G26", """SELECT l_returnflag AS before, CASE WHEN l_discount > 0.08 THEN 'baseline_only' ELSE l_returnflag END AS after, count(*) AS n FROM lineitem GROUP BY ALL""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.when(F.col("l_discount") > 0.08, "baseline_only").otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


@query("G27", """SELECT o_orderkey FROM orders ORDER BY sha256('7:' || o_orderkey), o_orderkey LIMIT 100""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.concat(F.lit("7:"), F.col("o_orderkey")).cast("binary"), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy(key, "o_orderkey").limit(100)


@query("G30 T05", """WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, date_diff('day', max(ts), any_value(now)) AS age, CASE WHEN date_diff('day', max(ts), any_value(now)) BETWEEN 0 AND 1 THEN 'fresh' ELSE 'stale' END AS state FROM events, n GROUP BY user_id""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    age = F.datediff("now", "last").cast("long")
    return last.select("user_id", age.alias("age"), F.when(age.between(0, 1), "fresh").otherwise("stale").alias("state"))


@query("P08 P14", """SELECT 'line' AS kind, count(*) AS violations FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'part', count(*) FROM lineitem ANTI JOIN part ON p_partkey = l_partkey
UNION ALL SELECT 'empty', count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'discount', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.1)""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    return quality.violations({
        "line": lines.join(orders, "l_orderkey", "left_anti"), "part": lines.join(parts, "l_partkey", "left_anti"),
        "empty": orders.join(lines.select("l_orderkey").distinct(), "l_orderkey", "left_anti"), "discount": lines.where(~F.col("l_discount").between(0, 0.1)),
    })


@query("V03", """SELECT o_orderstatus AS method, count(*) FILTER (WHERE o_orderpriority IS NULL OR o_orderpriority = '') AS missing, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice < 1000) AS forbidden, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2001-12-31') AS late FROM orders GROUP BY o_orderstatus""")
def provenance_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("method")).agg(
        F.count_if(F.coalesce("o_orderpriority", F.lit("")) == "").alias("missing"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 1000)).alias("forbidden"), F.count_if(F.col("o_orderdate") > F.lit("2001-12-31").cast("timestamp")).alias("late"))


@query("V04", """SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INTEGER) IS NULL) AS BIGINT) AS bad, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total FROM events GROUP BY event_type""")
def json_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("p.k").isNull()).alias("bad"), F.sum("p.k").alias("total"))


@query("V08", """WITH o AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 2000 GROUP BY 1) SELECT o.k AS nation, coalesce(w.n, 0) * 2 < o.n AS refused FROM o LEFT JOIN w USING (k)""")
def publish_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.count_if(F.col("c_acctbal") > 2000)
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg((kept * 2 < F.count("*")).alias("refused"))


@query("V10", """SELECT count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(strlen(text)) AS longest, count(*) <= 60000 AS within FROM documents""")
def row_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"), F.max(size).alias("longest"), (F.count("*") <= 60000).alias("within"))


_EVIDENCE = [("extends", "(?:ing|tion) (?:the|of)"), ("contrasts", "unter|contre"), ("uses", "\\b(?:with|mit|avec|con)\\b"), ("mentions", "[a-z]")]


@query("C01", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{r}'" for r, p in _EVIDENCE) + " END AS relation, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN {0.88 - 0.04 * k:.2f}" for k, (_, p) in enumerate(_EVIDENCE)) + " END::DOUBLE AS confidence FROM conversations WHERE text IS NOT NULL")
def context_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    hit = [any_of(low, [p]) for _, p in _EVIDENCE]
    relation = first_rule([(h, r) for h, (r, _) in zip(hit, _EVIDENCE, strict=True)])
    confidence = F.coalesce(*(F.when(h, round(0.88 - 0.04 * k, 2)) for k, h in enumerate(hit)))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", relation.alias("relation"), confidence.alias("confidence"))


@query("C02 C03 C09 C13 C14 C15", f"""WITH {EDGES_SQL} SELECT src, dst, CASE WHEN dst % 9 = 0 THEN 'version' WHEN relation = 'extends' THEN 'intent' WHEN src_year < dst_year - 1 THEN 'year_cite' ELSE 'llm' END AS method,
CASE WHEN dst % 9 = 0 THEN 'successor' WHEN relation = 'extends' THEN 'extends' WHEN src_year < dst_year - 1 THEN 'baseline_only' ELSE relation END AS relation, CASE WHEN dst % 9 = 0 THEN 0.9 WHEN relation = 'extends' THEN 0.8 WHEN src_year < dst_year - 1 THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence FROM edges""")
def relation_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first producer that answers wins; answers are structs joined by coalesce."""
    def answer(when, method: str, relation, confidence: float):
        return F.when(when, F.struct(F.lit(method).alias("method"), relation.alias("relation"), F.lit(confidence).alias("confidence")))

    old = F.col("src_year") < F.col("dst_year") - 1
    chosen = F.coalesce(
        answer(F.col("dst") % 9 == 0, "version", F.lit("successor"), 0.9), answer(F.col("relation") == "extends", "intent", F.col("relation"), 0.8),
        answer(old, "year_cite", F.lit("baseline_only"), 0.4), answer(F.lit(True), "llm", F.col("relation"), 0.5),
    )
    return edges(spark, sf_dir).select("src", "dst", chosen.alias("c")).select("src", "dst", "c.method", "c.relation", "c.confidence")


@query("C07 C12 C24", f"""WITH {EDGES_SQL} SELECT src, dst, CASE WHEN dst % 5 = 0 OR relation = 'contrasts' AND src % 2 = 0 THEN 'baseline_only' ELSE relation END AS relation, CASE WHEN dst % 5 = 0 OR relation = 'contrasts' AND src % 2 = 0 THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence FROM edges""")
def relation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.classify import guard

    judged = edges(spark, sf_dir).withColumns({"confidence": F.lit(0.8), "survey": F.col("dst") % 5 == 0, "context": F.col("src") % 2 == 1})
    return guard(judged, F.col("survey"), (F.col("relation") == "contrasts") & ~F.col("context")).select("src", "dst", "relation", "confidence")


@query("C17", """SELECT p_partkey, regexp_matches(lower(p_name), 'widget|gadget') AS foundational, p_type = 'PROMO' OR regexp_matches(lower(p_name), '\\b(?:red|blue)\\b') AS survey, len(string_split(p_name, ' ')) <= 2 AND p_size < 10 AS bogus FROM part""")
def record_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", any_of(low, ["widget", "gadget"]).alias("foundational"), ((F.col("p_type") == "PROMO") | any_of(low, [r"\b(?:red|blue)\b"])).alias("survey"),
        ((F.size(F.split("p_name", " ")) <= 2) & (F.col("p_size") < 10)).alias("bogus"))


@query("P10", """WITH k AS (SELECT DISTINCT p_type AS slug, string_split(p_name, ' ')[1] AS word FROM part WHERE p_size < 3) SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.slug = p.p_type AND contains(p.p_name, k.word))""")
def theme_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a theme forbids: equal theme first, then containment."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size")
    words = part.where("p_size < 3").select(F.col("p_type").alias("slug"), F.substring_index("p_name", " ", 1).alias("word")).distinct()
    return part.join(words, (F.col("slug") == F.col("p_type")) & F.contains(F.col("p_name"), F.col("word")), "left_anti").select("p_partkey")


@query("P18 R01", """WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS cited FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, cited, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS at FROM orders JOIN c ON l_orderkey = o_orderkey
WHERE o_orderstatus IN ('O', 'P') AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2000-12-31' AND cited >= 2 ORDER BY cited DESC, o_orderdate DESC, o_orderkey LIMIT 200""")
def citing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("cited")).where("cited >= 2")
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp"), F.lit("2000-12-31").cast("timestamp")))
    return recent.join(cited, "o_orderkey").orderBy(F.desc("cited"), F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "cited", F.to_date("o_orderdate").cast("string").alias("at"))


@query("W20", """SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'subject' WHEN label % 3 = 1 THEN 'component' ELSE 'abstract' END AS role, CASE label % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS weight,
round(CAST(embedding[1] AS DOUBLE) * 10, 3) >= CASE WHEN label % 3 = 0 THEN 0 WHEN label % 3 = 1 THEN 1.25 ELSE 1 END AS admitted FROM embeddings""")
def topic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.classify import admits, seed_weight

    role = F.when(F.col("label") % 3 == 0, "subject").when(F.col("label") % 3 == 1, "component").otherwise("abstract")
    z = F.round(F.get("embedding", F.lit(0)).cast("double") * 10, 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", role.alias("role"), seed_weight(role).alias("weight"), admits(role, z).alias("admitted"))


@query("P23 W09", """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE l_returnflag = 'R' OR rn <= 8""")
def foundational_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_partkey").orderBy(F.when(F.col("l_returnflag") == "R", 0).otherwise(1), "l_orderkey", "l_linenumber", "l_suppkey")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order)).where("l_returnflag = 'R' or rn <= 8").select("l_partkey", "l_orderkey", "l_linenumber")
