"""Queries that classify citations by what is said of the cited work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import evidence
from lectern.plans.registry import query
from lectern.plans.views import EDGES_SQL, edges, table

_KINDS = (
    ("We extend {0} to more layers", "extends", 0.84, "builds_on", "phrase_build", "builds_on", "phrase_build"),
    ("Unlike {0}, we need no labels", "contrasts", 0.86, "compares_with", "phrase_contrast", "compares_with", "first_person_contrast"),
    ("Results surpass {0} by far", "supersedes", 0.88, "compares_with", "phrase_compare", "background", "context_no_cue"),
    ("The benchmark of {0} is used throughout", None, None, "uses_resource", "phrase_resource", "uses_resource", "clause_resource"),
    ("An ablation of {0} shows little", "ablation", 0.82, "background", "context_no_cue", "background", "context_no_cue"),
    ("See also {0} for a history", None, None, "background", "context_no_cue", "background", "context_no_cue"),
)


def _case(column: int, k: str, quote: bool = True) -> str:
    def told(value) -> str:
        return "NULL" if value is None else f"'{value}'" if quote else str(value)

    return f"CASE {k} " + " ".join(f"WHEN {n} THEN {told(row[column])}" for n, row in enumerate(_KINDS)) + " END"


def _sentence(k, name):
    out = F.lit(None).cast("string")
    for n, row in reversed(list(enumerate(_KINDS))):
        head, tail = row[0].split("{0}")
        out = F.when(k == n, F.concat(F.lit(head), name, F.lit(tail))).otherwise(out)
    return out


@query("C01", f"""SELECT p_partkey, {_case(1, 'p_size % 6')} AS relation, CAST({_case(2, 'p_size % 6', False)} AS DOUBLE) AS confidence FROM part""")
def context_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation classes of citing sentences, by the first class whose pattern one of a work's sentences holds."""
    k = F.col("p_size") % 6
    part = table(spark, sf_dir, "part").select("p_partkey", evidence.context_relation(F.array(F.lit("See also others."), _sentence(k, F.col("p_name")))).alias("r"))
    return part.select("p_partkey", "r.relation", "r.confidence")


@query("C06 C07 C09", f"""WITH p AS (SELECT p_partkey, p_name, p_size, p_size % 6 AS k, p_partkey % 7 = 0 AS gone, p_partkey % 5 = 0 AS survey, p_partkey % 3 = 0 AS bare, p_partkey % 4 = 0 AS method FROM part),
r AS (SELECT p_partkey, CASE WHEN gone THEN 'cites_unspecified' WHEN bare THEN CASE WHEN method THEN 'builds_on' ELSE 'cites_unspecified' END WHEN {_case(4, 'k')} = 'context_no_cue' AND method THEN 'builds_on' ELSE {_case(3, 'k')} END AS first,
  CASE WHEN gone THEN 'pair_missing' WHEN bare THEN CASE WHEN method THEN 'intent_methodology' ELSE 'no_context' END WHEN {_case(4, 'k')} = 'context_no_cue' AND method THEN 'intent_methodology' ELSE {_case(4, 'k')} END AS first_rule,
  CASE WHEN gone THEN 'cites_unspecified' WHEN survey THEN 'background' WHEN bare THEN CASE WHEN method THEN 'builds_on' ELSE 'cites_unspecified' END WHEN {_case(6, 'k')} = 'context_no_cue' AND method THEN 'builds_on' ELSE {_case(5, 'k')} END AS strict,
  CASE WHEN gone THEN 'pair_missing' WHEN survey THEN 'survey' WHEN bare THEN CASE WHEN method THEN 'intent_influential' ELSE 'no_context' END WHEN {_case(6, 'k')} = 'context_no_cue' AND method THEN 'intent_influential' ELSE {_case(6, 'k')} END AS strict_rule FROM p)
SELECT *, CAST(CASE first_rule WHEN 'phrase_build' THEN 0.8 WHEN 'phrase_contrast' THEN 0.7 WHEN 'phrase_compare' THEN 0.75 WHEN 'phrase_resource' THEN 0.7 WHEN 'intent_methodology' THEN 0.65 WHEN 'context_no_cue' THEN 0.45 ELSE 0.3 END AS DOUBLE) AS first_confidence,
  CAST(CASE strict_rule WHEN 'phrase_build' THEN 0.8 WHEN 'clause_resource' THEN 0.7 WHEN 'first_person_contrast' THEN 0.7 WHEN 'survey' THEN 0.8 WHEN 'intent_influential' THEN 0.5 WHEN 'context_no_cue' THEN 0.6 ELSE 0.3 END AS DOUBLE) AS strict_confidence, CASE strict WHEN 'builds_on' THEN 'extends' WHEN 'compares_with' THEN 'contrasts' ELSE 'baseline_only' END AS lineage FROM r""")
def pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the first and the revised rules; some have no sentences, no record, a survey as citing work or an intent."""
    p = F.col("p_partkey")
    contexts = F.when(p % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(_sentence(F.col("p_size") % 6, F.col("p_name"))))
    found, method = p % 7 != 0, p % 4 == 0
    intents = F.when(method, F.array(F.lit("Methodology"))).otherwise(F.array().cast("array<string>"))
    title = F.when(p % 5 == 0, "A survey of things").otherwise("Things")
    rows = table(spark, sf_dir, "part").select(p, found.alias("f"), contexts.alias("c"), intents.alias("i"), method.alias("m"), title.alias("t"))
    no = F.lit(False)
    judged = rows.select(p, evidence.pair_relation(F.col("f"), F.col("c"), F.col("i"), no, no).alias("a"), evidence.pair_relation_strict(F.col("f"), F.col("c"), F.col("i"), F.col("m"), F.col("t")).alias("b"))
    return judged.select("p_partkey", F.col("a.relation").alias("first"), F.col("a.rule").alias("first_rule"), F.col("b.relation").alias("strict"), F.col("b.rule").alias("strict_rule"), F.col("a.confidence").alias("first_confidence"), F.col("b.confidence").alias("strict_confidence"), evidence.lineage_relation(F.col("b.relation"), F.lit(True)).alias("lineage"))


@query("C10 C11", """SELECT p_partkey, p_size % 3 = 0 AS named, CASE p_size % 3 WHEN 0 THEN 'We build on ' || p_name || ' [3].' WHEN 1 THEN 'Much is known [3].' ELSE 'No marker here.' END AS quote FROM part""")
def cited_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cue's clause names the cited work, and the best sentence to quote for it."""
    k, name = F.col("p_size") % 3, F.col("p_name")
    first = F.when(k == 0, F.concat(F.lit("We build on "), name, F.lit(" [3]."))).when(k == 1, "Much is known [3].").otherwise("No marker here.")
    contexts = F.array(F.lit("We build on other works [1], [2]."), F.lit("Others too [4]."), first)
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", evidence.cue_names(first, F.array(name), F.lit(3), [r"build(s|ing)?\s+(on|upon)"]).alias("named"), evidence.picked_quote(contexts, F.array(name), F.lit(3)).alias("quote"))


@query("C13 C14 C15 C18 C24", f"""WITH {EDGES_SQL}, e AS (SELECT src, dst, relation, CASE gap WHEN 2 THEN 'year_cite' WHEN 1 THEN CASE WHEN src % 2 = 0 THEN 'llm' ELSE 'context_pattern' END END AS method, dst % 3 = 0 AS confirmed, src % 4 + 1 AS prompt FROM edges)
SELECT src, dst, CASE WHEN method = 'year_cite' THEN 'baseline_only' ELSE relation END AS relation, CASE WHEN method = 'year_cite' THEN 0.4 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN method = 'year_cite' AND confirmed THEN 'api_citation' ELSE method END AS method,
  sha256('refs' || chr(10) || src || chr(10) || dst) AS evidence, CASE WHEN src % 5 = 0 THEN method WHEN src % 5 = 1 THEN 'template' ELSE 'llm' END AS bucket, src % 3 <> 0 AND (method = 'context_pattern' OR (method = 'llm' AND prompt >= 3)) AS stands FROM e""")
def edge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demoted guesses, confirmed citations with hashed evidence, buckets of origin, and claims that may stand."""
    s = F.col("src")
    method = F.when(F.col("gap") == 2, "year_cite").when(s % 2 == 0, "llm").otherwise("context_pattern")
    rows = edges(spark, sf_dir).select("src", "dst", "relation", method.alias("m"))
    weak, alone = evidence.demoted(F.col("relation"), F.lit(0.8), F.col("m")), evidence.without_model(F.col("m"), F.col("dst") % 3 == 0)
    rationale = F.when(s % 5 == 1, F.concat(F.lit("This work builds on "), s)).otherwise("it says so")
    bucket = evidence.provenance_bucket(F.when(s % 5 == 0, F.col("m")), rationale, ["^This work builds on [0-9]+$"])
    stands = evidence.build_stands(F.col("m"), s % 4 + 1, F.when(s % 3 != 0, "quote"))
    return rows.select("src", "dst", weak["relation"].alias("relation"), weak["confidence"].alias("confidence"), alone["method"].alias("method"), evidence.evidence_hash(F.lit("refs"), s, F.col("dst")).alias("evidence"), bucket.alias("bucket"), stands.alias("stands"))
