"""Queries over landed responses and sinks: each exports a table in the response's format and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import records, text
from lectern.operators.inverted import inverted_indexes
from lectern.plans.registry import query
from lectern.plans.storage import shared_dir
from lectern.plans.views import table
from lectern.sources import exports, landed


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("S07", """SELECT '2025.x-' || volume || '.' || p_partkey AS stub, p_name || ' & <co>' AS title, CASE WHEN p_size % 3 = 0 THEN 'Ann Lee' ELSE 'Ann Lee; Bo Yu' END AS authors FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'demo' END AS volume FROM part) WHERE volume IN ('long', 'short') AND p_partkey % 10 <> 0""")
def anthology_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the main volumes of an anthology's XML; front matter has no authors and stays out. A volume is written in
    parts of some thousand papers, so no task holds a whole one."""
    size, k = F.col("p_size"), F.col("p_partkey")
    volume = F.when(size % 4 == 0, "long").when(size % 4 == 1, "short").otherwise("demo")

    def person(first: str, last: str):
        return F.struct(F.lit(first).alias("first"), F.lit(last).alias("last"))

    authors = F.when(k % 10 == 0, F.array().cast("array<struct<first: string, last: string>>")).when(size % 3 == 0, F.array(person("Ann", "Lee"))).otherwise(F.array(person("Ann", "Lee"), person("Bo", "Yu")))
    papers = table(spark, sf_dir, "part").select(volume.alias("volume"), F.struct(k.alias("_id"), F.concat(F.col("p_name"), F.lit(" & <co>")).alias("title"), authors.alias("author")).alias("paper"), F.floor(k / 4096).alias("part"))
    volumes = papers.groupBy(F.col("volume").alias("_id"), "part").agg(F.collect_list("paper").alias("paper")).drop("part")
    path = _place(spark, "anthology")
    volumes.write.format("xml").option("rootTag", "collection").option("rowTag", "volume").save(path)
    return landed.anthology_papers(spark, path, "2025.x", ["long", "short"])


@query("S25 S24", """SELECT 'conf/x/' || p_partkey AS key, p_name AS title, NULLIF(p_brand, 'Brand#1') AS venue, CASE WHEN p_size % 5 <> 0 THEN CAST(1990 + p_size % 30 AS INTEGER) END AS year, CASE WHEN p_size % 2 = 0 THEN ['Ann Lee', 'Bo Yu 0001'] ELSE [] END AS authors FROM part""")
def bibliography_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a bibliography's query answer: bindings of values, authors joined by bars, years as text."""
    def value(c):
        return F.struct(c.cast("string").alias("value"))

    size = F.col("p_size")
    part = table(spark, sf_dir, "part").select(
        value(F.concat(F.lit("https://dblp.org/rec/conf/x/"), F.col("p_partkey"))).alias("pub"), value(F.col("p_name")).alias("title"), F.when(F.col("p_brand") != "Brand#1", value(F.col("p_brand"))).alias("venue"),
        value(F.when(size % 5 != 0, (F.lit(1990) + size % 30).cast("string")).otherwise("n/a")).alias("year"), value(F.when(size % 2 == 0, "Ann Lee|Bo Yu 0001").otherwise("")).alias("authors"))
    path = _place(spark, "bindings")
    exports.json_export(part, path)
    return landed.bibliography_records(spark, path)


@query("S27", """SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderkey % 3 <> 0""")
def versioned_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the schema version that is asked for; others count as absent."""
    path = _place(spark, "cache")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2).alias("schema_version"))
    exports.json_export(rows, path)
    return landed.versioned(spark, path, "id long, value double", 2)


@query("S04 F11", """SELECT doc_id AS id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS abstract, CAST(2015 + doc_id % 10 AS INTEGER) AS year FROM documents WHERE length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) > 0""")
def works_with_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed works carry their abstract as a map from word to places."""
    words = text.collapse(F.col("text"))
    index = inverted_indexes(table(spark, sf_dir, "documents").where(F.char_length(words) > 0).select("doc_id", words.alias("text"))).withColumnRenamed("index", "abstract_inverted_index")
    path = _place(spark, "works")
    exports.json_export(index.select(F.concat(F.lit("https://openalex.org/W"), "doc_id").alias("id"), F.lit("t").alias("title"), (F.lit(2015) + F.col("doc_id") % 10).cast("int").alias("year"), "abstract_inverted_index"), path)
    works, _ = landed.json_rows(spark, path, landed.WORKS)
    from lectern.functions.identity import work_id

    return works.select(F.substring(work_id(F.col("id")), 2, 20).cast("long").alias("id"), text.decode_inverted_index(F.col("abstract_inverted_index")).alias("abstract"), "year")


@query("S29", """WITH c AS (SELECT o_orderkey, o_custkey % 300 AS arxiv, CASE o_orderpriority WHEN '1-URGENT' THEN 'Accepted at ICML 2024 (Oral)' WHEN '2-HIGH' THEN 'accepted at the ICML' WHEN '3-MEDIUM' THEN 'to appear in CVPR' ELSE '9 pages' END AS comment FROM orders), t AS (SELECT * FROM c WHERE contains(comment, 'ICML'))
SELECT arxiv, o_orderkey AS id, contains(comment, 'Oral') AS oral FROM t QUALIFY row_number() OVER (PARTITION BY arxiv ORDER BY o_orderkey) = 1""")
def declared_acceptances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprints whose comment says that one venue took them, the first of each number, and whether it says oral."""
    priority = F.col("o_orderpriority")
    comment = F.when(priority == "1-URGENT", "Accepted at ICML 2024 (Oral)").when(priority == "2-HIGH", "accepted at the ICML").when(priority == "3-MEDIUM", "to appear in CVPR").otherwise("9 pages")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 300).alias("arxiv"), comment.alias("comment"))
    taken = rows.where(records.comment_venue(F.col("comment"))["venue"] == "ICML")
    first = taken.groupBy("arxiv").agg(F.min_by(F.struct("o_orderkey", "comment"), "o_orderkey").alias("f"))
    return first.select("arxiv", F.col("f.o_orderkey").alias("id"), (records.decision_label(F.col("f.comment")) == "Oral").alias("oral"))


@query("S31 S32", """WITH a AS (SELECT c_mktsegment AS namespace, CAST(c_nationkey AS VARCHAR) AS value, c_custkey AS paper FROM customer), m AS (SELECT namespace, value, list(DISTINCT paper ORDER BY paper) AS papers FROM a GROUP BY ALL)
SELECT namespace, value, papers[1] AS first, CAST(len(papers) AS BIGINT) AS claims, len(papers) = 1 AS unique_claim FROM m""")
def alias_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that an alias names; a side file may be used only where the claim is unique."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("namespace"), F.col("c_nationkey").cast("string").alias("value"), F.col("c_custkey").alias("paper"))
    return landed.alias_claims(rows)


@query("S08 S10 S11", """WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>')) AS b, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>'), 1) AS pos FROM pages),
f AS (SELECT page_id, pos, trim(regexp_replace(regexp_extract(b, '"([^"]*)"', 1), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS path, trim(regexp_replace(regexp_extract(b, '>([^<]*)<', 1), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS title FROM b), d AS (SELECT * FROM f WHERE path <> '' AND title <> '' QUALIFY row_number() OVER (PARTITION BY page_id, path ORDER BY pos) = 1)
SELECT page_id, path, title, substr(sha256('lectern:v1:listing:' || path), 1, 40) AS id FROM d""")
def listing_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of listing pages: the first of repeated paths, malformed blocks left out, ids of the paths."""
    from lectern.functions.identity import stable_id

    rows = landed.listing_rows(table(spark, sf_dir, "pages").select("page_id", "html"), '<a href="[^"]*"[^>]*>[^<]*</a>', {"path": '"([^"]*)"', "title": ">([^<]*)<"}, key="path")
    return rows.select("page_id", "path", "title", stable_id(F.lit("listing"), F.col("path")).alias("id"))


@query("S09 S12 S13", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Ann Lee; Bo Yu' ELSE 'Ann Lee' END AS authors, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS abstract FROM part""")
def flipped_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author cells of details (Last, First), split and flipped; abstracts joined from the volume's bibliography."""
    part = table(spark, sf_dir, "part")
    cell = F.when(F.col("p_size") % 2 == 0, "Lee, Ann and Yu, Bo").otherwise("Lee, Ann")
    entry = exports.bibtex_entries("inproceedings", F.concat(F.lit("k"), F.col("p_partkey")), {"abstract": F.col("p_type"), "year": F.lit("2020")})
    bib = landed.bibtex_fields(part.where("p_partkey % 3 = 0").select("p_partkey", entry.alias("entry")), "entry", ["abstract"]).drop("entry")
    return part.select("p_partkey", landed.flipped_names(cell).alias("a")).join(bib, "p_partkey", "left").select("p_partkey", F.array_join("a", "; ").alias("authors"), "abstract")


@query("K04", """WITH t AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders QUALIFY k <= 10), l AS (SELECT k, k || '. a & b <' || o_orderkey || '> (' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ')' AS line FROM t)
SELECT string_agg(line, chr(10) ORDER BY k) AS plain, '<ul>' || string_agg('<li>' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</li>', '' ORDER BY k) || '</ul>' AS html FROM l""")
def email_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows as a plain text and an HTML list."""
    line = F.concat(F.lit("a & b <"), F.col("o_orderkey"), F.lit("> ("), F.floor("o_totalprice").cast("string"), F.lit(")"))
    return exports.email_digest(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], line, 10)


@query("K15", """SELECT o_custkey AS theme, '| node | verdict |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || CASE o_orderstatus WHEN 'F' THEN 'right' WHEN 'O' THEN 'wrong' ELSE '' END || ' |', chr(10) ORDER BY o_orderkey) || chr(10) || count(*) FILTER (WHERE o_orderstatus = 'P') || ' unset' AS sheet FROM orders GROUP BY o_custkey""")
def audit_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theme's audit draft as a Markdown table with the count of unset verdicts."""
    verdict = F.when(F.col("o_orderstatus") == "F", "right").when(F.col("o_orderstatus") == "O", "wrong").otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("theme"), F.col("o_orderkey").alias("node"), verdict.alias("verdict"))
    return exports.audit_sheets(rows, "theme")


@query("R34", """WITH p AS (SELECT p_brand AS theme, list_sort(list(DISTINCT p_name)) AS phrases FROM part WHERE p_size <= 3 GROUP BY p_brand) SELECT theme, array_to_string(list_concat(list_transform(phrases, lambda x: CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END), ['LLM']), ' | ') AS search FROM p""")
def descendant_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for a theme's descendants: its phrases in quotes, its acronyms, joined by bars."""
    themes = table(spark, sf_dir, "part").where("p_size <= 3").groupBy(F.col("p_brand").alias("theme")).agg(F.array_sort(F.collect_set("p_name")).alias("phrases"))
    clean = F.filter(F.transform("phrases", lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))), lambda x: x != "")
    quoted = F.transform(clean, lambda x: F.when(F.contains(x, F.lit(" ")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    return themes.select("theme", F.array_join(F.array_distinct(F.concat(quoted, F.array(F.lit("LLM")))), " | ").alias("search"))


@query("F53", """SELECT o_orderkey, sha256('{"a":' || o_custkey || ',"b":{"x":"' || o_orderpriority || '","y":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || '}}') AS digest FROM orders""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of a document with its keys in order, at every level."""
    row = F.struct(F.struct((F.col("o_orderstatus") == "F").alias("y"), F.col("o_orderpriority").alias("x")).alias("b"), F.col("o_custkey").alias("a"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", row.alias("r"))
    return orders.select("o_orderkey", exports.canonical_sha256(orders, "r").alias("digest"))


@query("T13 T11", """WITH e AS (SELECT event_id, user_id % 50 AS host, ts, CAST(event_id % 5 AS BIGINT) AS tries, CASE WHEN event_id % 7 = 0 THEN 30 END AS hint FROM events), w AS (SELECT *, CASE WHEN tries = 0 THEN 0 ELSE coalesce(hint * tries, CAST(pow(2, tries) AS BIGINT) - 1) END AS wait FROM e)
SELECT event_id, CAST(wait AS BIGINT) AS wait, CASE WHEN tries > 4 OR wait > 60 THEN 'gave_up' WHEN tries = 0 THEN 'first' ELSE 'retried' END AS outcome, coalesce(ts - lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id) < INTERVAL 3 SECOND, false) AS paced FROM w""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long logged calls wait: doubling seconds or the server's hint before each retry, until a deadline of a minute;
    and which calls come too soon after the one before to the same host."""
    k = F.col("event_id")
    log = table(spark, sf_dir, "events").select(k, (F.col("user_id") % 50).alias("host"), "ts", (k % 5).cast("long").alias("tries"), F.when(k % 7 == 0, 30).alias("hint"))
    wait = F.when(F.col("tries") == 0, 0).otherwise(F.coalesce(F.col("hint") * F.col("tries"), F.pow(F.lit(2), F.col("tries")).cast("long") - 1)).cast("long")
    before = F.lag("ts").over(Window.partitionBy("host").orderBy("ts", "event_id"))
    outcome = F.when((F.col("tries") > 4) | (F.col("wait") > 60), "gave_up").when(F.col("tries") == 0, "first").otherwise("retried")
    return log.withColumn("wait", wait).select("event_id", "wait", outcome.alias("outcome"), F.coalesce(F.col("ts") - before < F.expr("INTERVAL 3 SECOND"), F.lit(False)).alias("paced"))


@query("V04 V11", """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value, event_type FROM events)
SELECT event_id, list_filter([CASE WHEN k IS NULL THEN 'props.k: required' END, CASE WHEN k >= 90 THEN 'props.k: above 89' END, CASE WHEN value < 1 THEN 'value: below 1' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'event_type: not listed' END], lambda x: x IS NOT NULL) AS issues
FROM e WHERE k IS NULL OR k >= 90 OR value < 1 OR event_type NOT IN ('view', 'click', 'purchase', 'signup')""")
def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of nested documents under a schema of required fields, ranges and closed sets."""
    from lectern.operators.quality import schema_issues as found

    docs = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("props"), "value", "event_type")
    rules = [("props.k", "required"), ("props.k", "max", 89), ("value", "min", 1), ("event_type", "in", ["view", "click", "purchase", "signup"])]
    return found(docs, "event_id", rules)


@query("V12", """WITH h AS (SELECT o_orderkey AS node, CASE WHEN o_orderstatus = 'F' THEN 'right' ELSE 'wrong' END AS human, sha256(CASE WHEN o_orderkey % 8 = 0 THEN 'old' ELSE o_orderpriority END) AS draft, sha256(o_orderpriority) AS now FROM orders) SELECT CASE WHEN draft <> now THEN 'stale' ELSE human END AS verdict, count(*) AS n FROM h GROUP BY 1""")
def imported_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of people taken over where the draft's hash is that of the present evidence; others are stale."""
    def digest(c):
        return F.sha2(c.cast("binary"), 256)

    orders = table(spark, sf_dir, "orders")
    drafts = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "right").otherwise("wrong").alias("human"), digest(F.when(F.col("o_orderkey") % 8 == 0, "old").otherwise(F.col("o_orderpriority"))).alias("hash"))
    now = orders.select("o_orderkey", digest(F.col("o_orderpriority")).alias("now"))
    verdict = F.when(F.col("hash") != F.col("now"), "stale").otherwise(F.col("human"))
    return drafts.join(now, "o_orderkey").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
