"""Source and sink queries: tables are exported, landed in the shared folder and read back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.identity import stable_id
from lectern.plans.registry import query
from lectern.plans.storage import shared_dir
from lectern.plans.views import TITLE_SQL, table, title_of
from lectern.sources import exports, landed


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("K01 K11 K14 S12 S16", f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' ELSE '' END || {TITLE_SQL} || ' "q"' || chr(10) || 'x' AS title, lang || '; ' || source AS tags FROM documents""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.when(F.col("doc_id") % 4 == 0, "=").otherwise(""), title_of(F.col("text")), F.lit(' "q"\nx'))
    path = _place(spark, "csv")
    exports.csv_export(table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.array("lang", "source").alias("tags")), path, ["title"])
    return landed.csv_rows(spark, path, "doc_id long, title string, tags string").withColumn("title", text.formula_unguard(F.col("title")))


@query("K02 S03 T02", """SELECT o_orderkey AS id, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    orders, path = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), _place(spark, "json")
    exports.json_export(orders.join(lines, "id"), path)
    good, _ = landed.json_rows(spark, path, "id long, lines array<struct<l_linenumber: int, l_quantity: double>>")
    return good.select("id", F.explode("lines").alias("l")).groupBy("id").agg(F.count("*").alias("lines"), F.sum("l.l_quantity").alias("quantity"))


@query("T02 S05", """SELECT count(*) FILTER (WHERE event_id % 50 <> 0) AS good, count(*) FILTER (WHERE event_id % 50 = 0) AS quarantined FROM events""")
def json_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "broken")
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props")).alias("value")).write.text(path)
    good, bad = landed.json_rows(spark, path, "k int")
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("quarantined")))


@query("S01 S02 K09", f"""SELECT 'doc:' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'a & b <c>' ELSE lang END AS title, CAST(1 + doc_id % 2 AS INTEGER) AS authors FROM documents""")
def atom_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("Ann Lee").alias("name")))).otherwise(F.array(F.struct(F.lit("Ann Lee").alias("name")), F.struct(F.lit("Bo Yu").alias("name"))))
    feed = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"), F.when(F.col("doc_id") % 3 == 0, "a & b <c>").otherwise(F.col("lang")).alias("title"),
        F.lit("none").alias("summary"), F.lit("2024-01-01").alias("published"), names.alias("author"), F.array(F.struct(F.col("source").alias("_term"))).alias("category"),
    )
    path = _place(spark, "atom")
    exports.atom_export(feed, path)
    return landed.atom_entries(spark, path).select("id", "title", F.size("author").alias("authors"))


@query("K06 K07", """WITH x AS (SELECT substr(sha256('lectern:v1:part:' || p_partkey), 1, 2) AS prefix FROM part) SELECT prefix, count(*) AS n FROM x GROUP BY prefix""")
def detail_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards are written by prefix; a reader of a few of them prunes the rest."""
    path = _place(spark, "shards")
    exports.detail_shards(table(spark, sf_dir, "part").select(stable_id(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), "p_name"), path, "id")
    return spark.read.schema("id string, p_name string, prefix string").parquet(path).groupBy("prefix").agg(F.count("*").alias("n"))


@query("K05 K12 K13", """SELECT event_type AS stage, count(*) AS n FROM events GROUP BY event_type""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, counts = _place(spark, "history"), table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"))
    for k in range(2):
        exports.append_history(counts.agg(F.count_if(F.col("event_id") % 2 == k).alias("n")), path)
    return spark.read.schema("stage string, n long").json(path).groupBy("stage").agg(F.sum("n").alias("n"))


@query("K03", """SELECT '* ' || o_orderkey || ' (' || o_orderstatus || ') ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS line FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("* "), F.col("o_orderkey"), F.lit(" ("), F.col("o_orderstatus"), F.lit(") "), F.floor("o_totalprice").cast("string"))
    return exports.digest_lines(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], line, 25)


@query("K10 S13 S14", """SELECT p_partkey, '{A {nested} ' || p_name || '}' AS title, p_brand AS author FROM part""")
def bibtex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    title = F.concat(F.lit("{A {nested} "), F.col("p_name"), F.lit("}"))
    entry = exports.bibtex_entries("article", F.concat(F.lit("k"), F.col("p_partkey")), {"title": title, "author": F.col("p_brand"), "year": F.lit("2020")})
    return landed.bibtex_fields(part.select("p_partkey", entry.alias("entry")), "entry", ["title", "author"]).drop("entry")


@query("S06 S28", """SELECT conv_id AS id, role AS venue, length(coalesce(text, '')) AS n FROM conversations WHERE turn = 0""")
def nested_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def value(c):
        return F.struct(c.alias("value"))

    talk = table(spark, sf_dir, "conversations").where("turn = 0")
    content = F.struct(value(F.coalesce("text", F.lit(""))).alias("title"), value(F.array("role")).alias("authors"), value(F.col("role")).alias("venueid"))
    path = _place(spark, "notes")
    exports.json_export(talk.select(F.col("conv_id").cast("string").alias("id"), content.alias("content")), path)
    notes, _ = landed.json_rows(spark, path, landed.NOTES)
    return notes.select(F.col("id").cast("long").alias("id"), F.col("content.venueid.value").alias("venue"), F.char_length("content.title.value").cast("long").alias("n"))


@query("S08 S10 S11 S15", """SELECT page_id, pos, b AS path FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS b, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)""")
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landed.listing_rows(table(spark, sf_dir, "pages").select("page_id", "html"), '<a href="[^"]*"', {"path": '"([^"]*)"'})
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "path")


@query("S17 S18", """WITH s AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(x), 'with')) AS l FROM pages)
SELECT page_id, len(list_slice(l, 1, 5)) AS contexts FROM s WHERE len(l) > 0""")
def citation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = landed.context_sentences(table(spark, sf_dir, "pages").select("page_id", "html"), "with")
    return found.groupBy("page_id").agg(F.count("*").alias("contexts"))


@query("S20", """SELECT l_partkey AS work, 'references' AS kind, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey UNION ALL SELECT l_orderkey, 'citations', count(DISTINCT l_partkey) FROM lineitem GROUP BY l_orderkey""")
def related_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    def side(work: str, other: str, kind: str) -> DataFrame:
        return links.groupBy(F.col(work).alias("work")).agg(F.countDistinct(other).alias("n")).select("work", F.lit(kind).alias("kind"), "n")

    return side("l_partkey", "l_orderkey", "references").unionByName(side("l_orderkey", "l_partkey", "citations"))


@query("S05 S30 U01", """SELECT event_type AS source, user_id % 7 AS keyword, max(event_id % 60) AS total, count(*) AS seen, CASE WHEN max(event_id % 60) IS NULL THEN 'degraded' WHEN count(*) < max(event_id % 60) THEN 'truncated' ELSE 'complete' END AS status
FROM events GROUP BY ALL""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), (F.col("user_id") % 7).alias("keyword"), (F.col("event_id") % 60).alias("total"), F.lit(1).alias("one"))
    return landed.source_status(rows, "source", "keyword", "total", "one")


@query("S30", """SELECT o_custkey, min(o_orderkey) FILTER (WHERE k = 1) AS first_oral, count(*) AS orals FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_custkey""")
def oral_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    oral = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    first = F.min(F.struct("o_orderdate", "o_orderkey"))
    return oral.groupBy("o_custkey").agg(first.alias("f"), F.count("*").alias("orals")).select("o_custkey", F.col("f.o_orderkey").alias("first_oral"), "orals")


@query("F55", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a language model: JSON inside a code fence with text around it."""
    answer = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return table(spark, sf_dir, "events").select("event_id", F.from_json(inner, "k int").getField("k").alias("k"))


@query("F40 K08", f"""SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[*_%$#&|!]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS tidy FROM (SELECT doc_id, {TITLE_SQL} AS t FROM documents)""")
def tidy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.regexp_replace(title_of(F.col("text")), "[*_%$#&|!]+", " ")).alias("tidy"))


@query("W19", """SELECT event_type, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS newest FROM events GROUP BY event_type""")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in dated folders; the newest name of each group is picked from the names."""
    path = _place(spark, "dated")
    table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").cast("string").alias("day")).repartition("event_type").write.partitionBy("event_type", "day").json(path)
    named = spark.read.schema("event_id long").option("recursiveFileLookup", "true").json(path).select(F.input_file_name().alias("file")).distinct()
    group, day = F.regexp_extract("file", "event_type=([^/]+)/", 1), F.regexp_extract("file", "day=([0-9-]+)/", 1)
    return named.groupBy(group.alias("event_type")).agg(F.max(day).alias("newest"))
