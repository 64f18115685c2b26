"""Version, provider and workflow classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import classify
from lectern.plans.registry import query
from lectern.plans.views import EDGES_SQL, edges, table


@query("C04", """WITH p AS (SELECT p_partkey, p_brand, p_name, p_size % 25 AS v FROM part) SELECT a.p_partkey AS parent, b.p_partkey AS child FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey
WHERE b.v <= 20 AND greatest(b.v, CASE WHEN b.v = 0 THEN 1 ELSE b.v END) > CASE WHEN a.v = 0 THEN 1 ELSE a.v END""")
def version_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_size") % 25
    title = F.concat("p_name", F.when(v == 0, "").otherwise(F.concat(F.lit(" v"), v.cast("string"))))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name", title.alias("title"))
    return classify.version_increments(p, ["p_brand", "p_name"])


@query("C05", """SELECT p_partkey, p_size % 3 + 1 >= 2 AND p_size % 2 = 0 AS increment FROM part""")
def acronym_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.concat(F.upper(classify.initialism(F.col("p_name"))), F.lit("-"), (F.col("p_size") % 3 + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", classify.is_acronym_increment(F.col("p_name"), child, F.col("p_size") % 2 == 0).alias("increment"))


def length_provider(texts: list[str]) -> list[tuple[int, str]]:
    """A stand-in for a language model: relevance by length, the first word as summary."""
    return [(1 + len(t or "") % 5, (t or "").split(" ")[0]) for t in texts]


@query("C20 W02", """SELECT doc_id, CAST(1 + length(text) % 5 AS INTEGER) AS relevance, string_split(text, ' ')[1] AS summary FROM documents""")
def provider_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.evaluate_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), length_provider, "text").drop("text")


@query("C23", f"""WITH {EDGES_SQL} SELECT src, dst, CASE WHEN gap = 2 AND src % 3 = 0 THEN 'extends' ELSE relation END AS relation FROM edges""")
def deferred_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = edges(spark, sf_dir)
    answers = whole.where("gap = 2 and src % 3 = 0").select("src", "dst", F.lit("extends").alias("relation"))
    return classify.relabel(whole.select("src", "dst", "relation"), answers, ["src", "dst"])


@query("C25", """WITH j AS (SELECT user_id, event_type, max(ts) >= TIMESTAMP '2024-01-25' AS done FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type)) FILTER (WHERE NOT done) AS stage FROM j GROUP BY user_id""")
def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.max("ts") >= F.lit("2024-01-25").cast("timestamp")).alias("done"))
    return classify.first_unfinished(jobs, "user_id", "event_type", F.col("done"), ["signup", "view", "click", "purchase", "error"])


@query("C22", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.07 THEN 'first' WHEN l_tax > 0.05 THEN 'second' ELSE 'last' END AS provider FROM lineitem""")
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = [F.when(F.col("l_discount") > 0.07, "first"), F.when(F.col("l_tax") > 0.05, "second"), F.lit("last")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(*answers).alias("provider"))
