"""The literature model over the given tables: papers, catalog, citation edges, evidence and state events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.storage import parts_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_of(text, n: int = 8):
    """The first words of a text, white space runs as one blank."""
    head = F.regexp_extract(text, rf"^[ \t\r\n]*+((?:[^ \t\r\n]++[ \t\r\n]++){{0,{n - 1}}}[^ \t\r\n]*+)", 1)
    return F.trim(F.regexp_replace(head, r"[ \t\r\n]+", " "))


TITLE_SQL = "trim(regexp_replace(regexp_extract(text, '^[ \\t\\r\\n]*((?:[^ \\t\\r\\n]+[ \\t\\r\\n]+){0,7}[^ \\t\\r\\n]*)', 1), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"

PAPERS_SQL = f"""papers AS (SELECT doc_id AS ord, 'doc:' || doc_id AS uid, {TITLE_SQL} AS title, text AS abstract, lang AS category, d.source, n_chars,
  CAST(DATE '2018-01-01' + CAST(doc_id * 37 % 2900 AS INTEGER) AS VARCHAR) AS published_date, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as papers; labels are missing for most, as lookups are."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("uid"), title_of(F.col("text")).alias("title"), F.col("text").alias("abstract"),
        F.col("lang").alias("category"), "source", "n_chars", F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") * 37 % 2900).cast("int")).cast("string").alias("published_date"), "quality", "toxic",
    )


EDGES_SQL = """o AS (SELECT o_orderkey AS id, o_custkey AS graph_id, year(o_orderdate) AS yr, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS at,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
edges AS (SELECT a.graph_id, a.id AS src, b.id AS dst, a.yr AS src_year, b.yr AS dst_year, b.rn - a.rn AS gap,
  CASE b.priority WHEN '1-URGENT' THEN 'supersedes' WHEN '2-HIGH' THEN 'extends' WHEN '3-MEDIUM' THEN 'contrasts' ELSE 'baseline_only' END AS relation
  FROM o a JOIN o b ON a.graph_id = b.graph_id AND (b.rn = a.rn + 1 OR b.rn = a.rn + 2))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the papers of one graph per customer, in parts that don't grow with the table."""
    seq = Window.partitionBy("graph_id").orderBy("at", "id")
    orders = table(spark, sf_dir, "orders")
    parts = parts_of(orders.count())
    return (orders if parts is None else orders.repartition(parts, "o_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("graph_id"), F.year("o_orderdate").cast("long").alias("yr"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("at"),
    ).withColumn("rn", F.row_number().over(seq))


def relation_of(priority):
    return F.when(priority == "1-URGENT", "supersedes").when(priority == "2-HIGH", "extends").when(priority == "3-MEDIUM", "contrasts").otherwise("baseline_only")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order cites the one and the one before that of its customer: src is the older."""
    seq = Window.partitionBy("graph_id").orderBy("at", "id")
    later = F.array(*(F.struct(F.lead("id", k).over(seq).alias("dst"), F.lead("yr", k).over(seq).alias("dst_year"), F.lead("priority", k).over(seq).alias("p"), F.lit(k).cast("long").alias("gap")) for k in (1, 2)))
    return nodes(spark, sf_dir).select("graph_id", F.col("id").alias("src"), F.col("yr").alias("src_year"), later.alias("later")).withColumn("x", F.explode("later")).where("x.dst is not null").select(
        "graph_id", "src", "x.dst", "src_year", "x.dst_year", "x.gap", relation_of(F.col("x.p")).alias("relation")
    )
