"""Queries over citing sentences: candidates of each sentence, what their cues govern, and the relation of each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import relations
from lectern.plans.registry import query
from lectern.plans.views import table

#: A sentence of each kind, of a work named {0} with marker 7, and the pair's answer: relation, rule, confidence, contrast, lineage, target.
_KINDS = (
    ("We build upon {0} [7] and add a gate to each of its layers in turn.", "builds_on", "phrase_build", 0.8, False, "extends", "named"),
    ("Unlike {0} [7], our method needs no labels at all for what it learns.", "compares_with", "phrase_contrast", 0.7, True, "contrasts", "named"),
    ("We follow {0} [7] and train the model for ninety epochs in all.", "uses_resource", "phrase_protocol", 0.7, False, "baseline_only", "named"),
    ("For a fair comparison we run {0} [7] with the same width and depth.", "compares_with", "phrase_compare", 0.7, False, "baseline_only", "named"),
    ("In an ablation we also try {0} [7] in place of the last two blocks.", "compares_with", "phrase_ablation", 0.65, False, "baseline_only", "named"),
    ("Our model outperforms {0} [7] by a wide margin in most of the cases.", "compares_with", "phrase_compare", 0.75, False, "baseline_only", "named"),
    ("We adopt {0} [7] as the first stage of the whole pipeline here.", "uses_resource", "phrase_usage", 0.7, False, "baseline_only", "named"),
    ("Several works [3, 4, 5] study this problem from many different angles.", "background", "context_no_cue", 0.6, False, "baseline_only", "named"),
    ("We build upon the gates of other people [3] in each of the layers.", "background", "context_no_cue", 0.6, False, "baseline_only", "named"),
    ("While {0} [7] routes whole images, our convolutional application of it routes each patch.", "builds_on", "phrase_build", 0.7, False, "extends", "named"),
    ("", "compares_with", "intent_result", 0.6, False, "baseline_only", None),
    ("We build upon {0} [7] in this overview of the whole field of gates.", "background", "citing_survey", 0.8, False, "baseline_only", "named"),
    ("We are glad to see {0} [7] discussed so much in the whole field.", "builds_on", "abstract_build", 0.75, False, "extends", "named"),
    ("We build on the codebase of {0} [7] for all the parts shown here.", "uses_resource", "phrase_usage", 0.7, False, "baseline_only", "named"),
    ("Lee et al. [8] extend {0} [7] to more layers than anyone did before.", "background", "context_no_cue", 0.6, False, "baseline_only", "named"),
)
_FILLER = "See {0} [7] for a history of the whole field and its methods."
_ABSTRACT = "Nets are good. We build on {0} to do more with less in all cases."
#: The kinds whose sentence holds a build cue that governs the work, one that any of the weak cues does, and a contrast that does.
_STRONGLY, _WEAKLY, _CONTRASTING = (0, 11, 13), (0, 2, 6, 11, 13), (1,)


def _case(column: int) -> str:
    def told(value) -> str:
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value).lower()

    return "CASE k " + " ".join(f"WHEN {n} THEN {told(row[column])}" for n, row in enumerate(_KINDS)) + " END"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("{0}", "' || name || '") + "'"


_SENTENCE_SQL = "CASE k " + " ".join(f"WHEN {n} THEN {_sql_text(row[0])}" for n, row in enumerate(_KINDS)) + " END"
_PARTS_SQL = f"p AS (SELECT p_partkey, 'Net' || p_partkey AS name, p_partkey % {len(_KINDS)} AS k, p_partkey % 17 <> 0 AS found FROM part), s AS (SELECT *, {_SENTENCE_SQL} AS sentence, {_sql_text(_FILLER)} AS filler FROM p)"


def _text(pattern: str, name: Column) -> Column:
    head, *tails = pattern.split("{0}")
    return F.concat(F.lit(head), *(x for tail in tails for x in (name, F.lit(tail))))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each part: what it cites is a work named after it, in a sentence of one kind and one without a cue."""
    k, name = F.col("p_partkey") % len(_KINDS), F.concat(F.lit("Net"), F.col("p_partkey").cast("string"))
    sentence = F.lit("")
    for n, row in enumerate(_KINDS):
        sentence = F.when(k == n, _text(row[0], name)).otherwise(sentence)
    contexts = F.when(k == 10, F.array().cast("array<string>")).otherwise(F.array(sentence, _text(_FILLER, name)))
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1_000_000).alias("src"), F.col("p_partkey").alias("dst"), (F.col("p_partkey") % 17 != 0).alias("found"), contexts.alias("contexts"),
        F.when(k == 10, F.array(F.lit("Result"))).otherwise(F.array().cast("array<string>")).alias("intents"), F.lit(False).alias("influential"),
        F.when(k == 11, "Gates: a survey").otherwise("On gates").alias("citing_title"), F.when(k == 12, _text(_ABSTRACT, name)).alias("citing_abstract"), F.lit(None).cast("boolean").alias("citing_survey"),
        F.concat(name, F.lit(": gates in layers")).alias("cited_title"), F.array(F.lit("Ann Lee"), F.lit("Bo Yu"), F.lit("Cy Fox"), F.lit("Di Orr")).alias("cited_authors"),
    )


@query("C08 C16", f"""WITH {_PARTS_SQL}
SELECT p_partkey AS dst, CASE WHEN found THEN {_case(1)} ELSE 'cites_unspecified' END AS relation, CASE WHEN found THEN {_case(2)} ELSE 'pair_missing' END AS rule, CAST(CASE WHEN found THEN {_case(3)} ELSE 0.3 END AS DOUBLE) AS confidence,
  found AND {_case(4)} AS contrast, CASE WHEN found THEN {_case(5)} END AS lineage, CASE WHEN found THEN {_case(6)} END AS target,
  CASE WHEN NOT found OR k = 10 THEN NULL WHEN k IN (7, 8) THEN filler WHEN k = 12 THEN 'We build on ' || name || ' to do more with less in all cases.' WHEN k = 14 THEN filler ELSE sentence END AS evidence, found AND k IN (7, 8, 14) AS deferred FROM s""")
def claim_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pair's sentences claim of the cited work: the best candidate, else intents, else background; and whether it is
    left for a model to decide."""
    return relations.relations(_pairs(spark, sf_dir)).select("dst", "relation", "rule", "confidence", "contrast", "lineage", "target", "evidence", "deferred")


@query("C10", f"""WITH {_PARTS_SQL}
SELECT p_partkey AS dst, sentence, CASE WHEN k IN (7, 8) THEN 'other' ELSE 'named' END AS target, k IN {_STRONGLY} AS strongly, k IN {_WEAKLY} AS weakly, k IN {_CONTRASTING} AS contrasts, k = 13 AS usage FROM s WHERE k NOT IN (10, 9)
UNION ALL SELECT p_partkey, filler, 'named', false, false, false, false FROM s WHERE k NOT IN (10, 9)""")
def governed_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each citing sentence, how it points at the cited work and which kinds of cue govern it."""
    pairs = _pairs(spark, sf_dir).where(~(F.col("dst") % len(_KINDS)).isin(9, 10))
    seen = relations.sentences(relations.identified(pairs)).where("not abstract")
    return seen.select("dst", F.col("s").alias("sentence"), "target", "strongly", "weakly", "contrasts", "usage")


@query("C08", f"""WITH {_PARTS_SQL}
SELECT k, count(*) FILTER (WHERE k = 2) AS protocol, count(*) FILTER (WHERE k = 3) AS fair, count(*) FILTER (WHERE k = 4) AS ablation, count(*) FILTER (WHERE k NOT IN (7, 8, 14)) AS told FROM s WHERE k NOT IN (10, 12) GROUP BY k""")
def vetoed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that a veto turns away from building, and those with a candidate, by kind."""
    seen = relations.candidates(relations.sentences(relations.identified(_pairs(spark, sf_dir)))).where(~F.col("abstract") & (F.col("place") == 0)).withColumn("k", F.col("dst") % len(_KINDS)).where("k not in (10, 12)")
    return seen.groupBy("k").agg(F.count_if("protocol").alias("protocol"), F.count_if("fair").alias("fair"), F.count_if("ablation").alias("ablation"), F.count_if(F.col("candidate").isNotNull()).alias("told"))
