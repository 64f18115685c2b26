"""What citing papers say of cited ones, sentence by sentence: candidates with vetoes and ranks, the best of each pair, and what
no rule decides.

A pair row has src and dst, found (whether the source knows the pair), contexts (citing sentences), intents, influential, citing_title,
citing_abstract, citing_survey (null: by title), cited_title and cited_authors. Each sentence becomes a row; its cues, its
vetoes (protocol, fair comparison, ablation) and the target that the clause scanner tells give a candidate or none; candidates
of a pair are reduced by rank, of equals the first. Pairs are independent and shuffled once, by pair, with map-side
maxima.

Defined cases: null arrays are empty; sentences that repeat are one; a pair without sentences has no candidates and is decided by
its intents, else unspecified; rows of one pair are one pair; further columns don't take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import cues, targets
from lectern.functions.records import is_survey_title, known
from lectern.functions.rules import any_of

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(“\"])"
QUANTITY = [r"\b(?:we|I)\s+(?:\w+\s+){0,2}extend(?:ed|s)?\s+the\s+(?:length|size|number|amount|range|depth|width)\s+of\b"]
OWN_BASELINE = r"(?i)(?<![0-9A-Za-z_])(?:we|this\s+(?:paper|work))\s+(?:propose|present|introduce|establish)s?\s+(?:an?\s+)?(?:[\w-]+\s+){0,2}baselines?(?![0-9A-Za-z_])"
MODEL_AS_IN = [r"\b(models?|sizes?|layers?|hidden|dimensions?|heads?|configurations?|depth|width)(?![0-9A-Za-z_])[^.;]{0,60}(?<![0-9A-Za-z_])as\s+in\s+(\[|\(|[A-Z])"]


#: Every match of these cues holds one of these parts, so a sentence without any is not read by the patterns.
PARTS = {
    "protocol": ("follow", "same", "identical", "similar", "matching", "result", "hyper", "warm", "learning", "schedul", "epoch", "batch", "weight", "dropout", "label", "augmentation", "based", "set", "code", "experimental"),
    "compare": ("outperform", "surpass", "superior", "better", "compar", "baseline", "state", "competitive", "improve"),
}


def _told(text: Column, patterns: list[str], parts: str | None = None) -> Column:
    """Whether a pattern matches; with ``parts``, where ``low``, the sentence in lower case, holds one of them."""
    found = any_of(text, [f"(?i){p}" for p in patterns])
    return found if parts is None else reduce(lambda a, b: a | b, (F.contains("low", F.lit(x)) for x in PARTS[parts])) & found


def _texts(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def identified(pairs: DataFrame) -> DataFrame:
    """One row a pair, with the names, surname and marker by which its sentences call the cited work."""
    one = pairs.groupBy("src", "dst").agg(*(F.first(c).alias(c) for c in ("found", "contexts", "intents", "influential", "citing_title", "citing_abstract", "citing_survey", "cited_title", "cited_authors")))
    return one.withColumn("who", targets.identities(F.col("cited_title"), F.col("cited_authors"), F.col("contexts")))


def sentences(pairs: DataFrame) -> DataFrame:
    """One row a sentence of each identified pair: place, whether it is of the abstract, and what the scanner sees in it."""
    def rows(texts: Column, abstract: bool) -> Column:
        kept = F.filter(F.array_distinct(F.transform(texts, lambda t: F.trim(F.regexp_replace(known(t), r"\s+", " ")))), lambda t: t != "")
        return F.transform(kept, lambda t, i: F.struct(t.alias("s"), i.alias("place"), F.lit(abstract).alias("abstract")))

    abstract = F.split(F.regexp_replace(known(F.col("citing_abstract")), r"\s+", " "), SENTENCE_END)
    every = F.concat(rows(_texts(F.col("contexts")), False), rows(abstract, True))
    out = pairs.select("src", "dst", "who", "citing_title", "cited_title", F.explode(every).alias("x")).select("src", "dst", "who", "citing_title", "cited_title", "x.*")
    seen = targets.sightings(F.col("s"), F.col("who.names"), F.col("who.surname"), F.col("who.marker"), F.col("abstract"))
    return out.withColumn("t", seen).select("src", "dst", "s", "place", "abstract", "citing_title", "cited_title", F.col("who.names").alias("names"), "t.*")


def candidates(seen: DataFrame) -> DataFrame:
    """Each sentence with its veto columns and its candidate (null: none)."""
    plain = F.regexp_replace("s", r"\bet\s+al\.", "et al")
    own = F.lower(F.regexp_extract(known(F.col("citing_title")), r"^([^:]{3,60}):", 1))
    itself = (own != "") & ~F.array_contains("names", own) & ~own.isin(*cues.GENERAL_WORDS, *cues.GENERAL_NAMES) & F.coalesce(F.contains("low", own) & F.regexp("low", F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), own, F.lit(r"\E(?!\p{L})"))), F.lit(False))
    flagged = seen.withColumn("low", F.lower("s")).withColumns({
        "strong": F.col("target").isin("named", "single"),
        "first": _told(F.col("s"), [r"(?<![\w-])(we|our|ours|this\s+(paper|work))(?![\w-])"]) | itself,
        "first_build": _told(F.col("s"), cues.FIRST_PERSON_BUILD),
        "protocol": _told(plain, cues.PROTOCOL, "protocol") | any_of(plain, [f"(?i:{MODEL_AS_IN[0].split('as')[0]})as{MODEL_AS_IN[0].split('as', 1)[1]}"]),
        "fair": _told(F.col("s"), cues.FAIR),
        "ablation": _told(F.col("s"), cues.ABLATION),
        "cue_compare": _told(F.regexp_replace("s", OWN_BASELINE, " "), cues.COMPARE, "compare"),
        "cue_compare_all": _told(F.col("s"), cues.COMPARE, "compare"),
        "cue_resource": _told(F.col("s"), cues.RESOURCE_CLAUSE),
        "cue_contrast": _told(F.col("s"), cues.CONTRAST),
        "while_ours": _told(F.col("s"), cues.WHILE_OURS),
        "own_application": _told(F.col("s"), cues.OWN_APPLICATION) & ~_told(F.col("s"), [*cues.CONTRAST, *cues.REPLACED]),
        "row_of_table": any_of(F.col("s"), cues.TABLE_ROW),
        "quantity": _told(F.col("s"), QUANTITY),
        "resource_title": F.regexp(known(F.col("cited_title")), F.lit(cues.RESOURCE_TITLE)),
    })
    c = F.col
    compare = c("cue_compare") & (c("first") | c("strong"))
    buildable = ~compare & c("first_build") & (c("target") != "pair") & ~c("grouped")
    builds = buildable & (c("own_variant") | c("strongly"))
    targeted = c("strong") & ~c("grouped") & (c("contrasts") | c("while_cites"))
    contrast = c("first") & (c("cue_contrast") | c("while_ours"))

    def told(relation: str, rule: str, confidence: float, contrast: Column | bool = False, scope: Column | bool = False) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(relation).alias("relation"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), as_column(contrast).alias("contrast"), as_column(scope).alias("scope"))

    nothing = F.lit(None).cast("struct<relation:string,rule:string,confidence:double,contrast:boolean,scope:boolean>")
    in_context = (
        F.when(~c("usable"), F.when(c("strong") & c("row_of_table"), told("compares_with", "table_row", 0.65)))
        .when(c("protocol"), F.when(c("fair") | c("cue_compare_all"), told("compares_with", "phrase_protocol", 0.7)).otherwise(told("uses_resource", "phrase_protocol", 0.7)))
        .when(c("fair"), told("compares_with", "phrase_compare", 0.7))
        .when(c("first") & c("ablation"), told("compares_with", "phrase_ablation", 0.65))
        .when(buildable & c("quantity"), told("uses_resource", "phrase_usage", 0.7))
        .when(builds & (c("usage") | c("resource_title")), told("uses_resource", "phrase_usage", 0.7))
        .when(builds, told("builds_on", "phrase_build", 0.8))
        .when(c("cue_resource"), told("uses_resource", "phrase_resource", 0.7))
        .when(contrast, told("compares_with", "phrase_contrast", 0.7, targeted, targeted & c("while_ours") & c("own_application")))
        .when(compare, told("compares_with", "phrase_compare", 0.75))
        .when(buildable & c("weakly"), told("uses_resource", "phrase_usage", 0.7))
        .when(c("strong") & c("row_of_table"), told("compares_with", "table_row", 0.65))
    )
    vetoed = ~c("usable") | c("protocol") | c("fair") | (c("first") & c("ablation")) | (buildable & c("quantity"))
    in_abstract = F.when(~c("named") | vetoed, nothing).when(builds & (c("usage") | c("resource_title")), nothing).when(builds, told("builds_on", "abstract_build", 0.75)).when(c("cue_resource"), nothing).when(contrast & targeted, told("compares_with", "abstract_contrast", 0.7, True))
    found = F.when(c("target").isin("named", "single", "unmarked", "pair"), F.when(c("abstract"), in_abstract).otherwise(in_context))
    quote = F.when(~c("usable") | c("abstract"), 0.0).when(c("named"), 4 + F.when(c("leads"), 0.5).otherwise(0.0) + 1 / (1 + c("cited"))).when(c("target") == "named", F.when(c("cited") <= 1, 3.0).otherwise(1.5)).when(c("target") == "single", 3.0).when(c("target") == "unmarked", 1.0).otherwise(0.0)
    rank = F.when(c("candidate.relation") == "builds_on", 4).when(c("candidate.contrast"), 3).when(c("candidate.relation") == "compares_with", 2).when(c("candidate").isNotNull(), 1).otherwise(0)
    return flagged.withColumn("candidate", found).withColumn("rank", rank).withColumn("quote_rank", quote)


def relations(pairs: DataFrame) -> DataFrame:
    """(src, dst, relation, rule, confidence, contrast, evidence, target, lineage, deferred) of each pair. lineage is what the relation
    counts for in a graph, null where nothing is known; deferred tells that sentences speak of the work and no rule decides."""
    one = identified(pairs)
    seen = candidates(sentences(one))
    c = F.col
    order, here = F.struct("rank", (-c("place")).alias("p")), F.struct("candidate", "s", "target", "rank")
    counted = (c("candidate").isNotNull()) & ~c("abstract")
    said = seen.groupBy("src", "dst").agg(
        F.max_by(F.when(counted, here), F.when(counted, order)).alias("context"),
        F.max_by(F.when(c("abstract") & (c("rank") >= 3), here), F.when(c("abstract") & (c("rank") >= 3), order)).alias("own"),
        F.bool_or(counted & ~c("candidate.scope") & ((c("candidate.relation") == "compares_with") & c("candidate.contrast") | (c("candidate.rule") == "phrase_compare"))).alias("explicit"),
        F.max_by(F.when(c("quote_rank") > 0, F.struct("s", "target")), F.when(c("quote_rank") > 0, F.struct("quote_rank", (-c("place")).alias("p")))).alias("quote"),
        F.bool_or(~c("abstract")).alias("any"), F.bool_or(~c("abstract") & c("usable") & c("target").isin("named", "single", "unmarked", "pair")).alias("speaks"),
    )
    joined = one.join(said, ["src", "dst"], "left").withColumn("best", F.when(F.coalesce(c("context.rank") < 3, F.lit(True)), F.coalesce("own", "context")).otherwise(c("context")))
    scoped = F.coalesce(c("best.candidate.scope"), F.lit(False)) & ~F.coalesce(c("explicit"), F.lit(False))
    low = F.transform(_texts(c("intents")), lambda i: F.lower(i))
    survey = F.coalesce(c("citing_survey"), is_survey_title(c("citing_title")))

    def told(relation: str, rule: str, confidence: float, quoted: bool = True) -> Column:
        text = F.struct(c("quote.s").alias("s"), c("quote.target").alias("target")) if quoted else F.lit(None).cast("struct<s:string,target:string>")
        return F.struct(F.lit(relation).alias("relation"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), F.lit(False).alias("contrast"), text["s"].alias("evidence"), text["target"].alias("target"))

    best = F.struct(
        F.when(scoped, "builds_on").otherwise(c("best.candidate.relation")).alias("relation"), F.when(scoped, "phrase_build").otherwise(c("best.candidate.rule")).alias("rule"), c("best.candidate.confidence").alias("confidence"),
        (c("best.candidate.contrast") & ~scoped).alias("contrast"), c("best.s").alias("evidence"), c("best.target").alias("target"),
    )
    singled = c("quote.target").isin("named", "single")
    answer = (
        F.when(~F.coalesce(c("found"), F.lit(False)), told("cites_unspecified", "pair_missing", 0.3, False))
        .when(survey, told("background", "citing_survey", 0.8))
        .when(c("best").isNotNull(), best)
        .when(F.array_contains(low, "result"), told("compares_with", "intent_result", 0.6))
        .when(F.array_contains(low, "methodology") & F.coalesce("influential", F.lit(False)) & F.coalesce(singled, F.lit(False)), told("background", "intent_methodology_influential", 0.6))
        .when(F.coalesce(c("any"), F.lit(False)), told("background", "context_no_cue", 0.6))
        .otherwise(told("cites_unspecified", "no_context", 0.3, False))
    )
    out = joined.select("src", "dst", answer.alias("a"), F.coalesce("speaks", F.lit(False)).alias("speaks")).select("src", "dst", "a.*", "speaks")
    lineage = F.when(c("relation") == "builds_on", "extends").when((c("relation") == "compares_with") & c("contrast") & c("target").isin("named", "single"), "contrasts").when(c("relation") != "cites_unspecified", "baseline_only")
    return out.withColumn("lineage", lineage).withColumn("deferred", c("rule").isin("context_no_cue", "intent_methodology_influential", "intent_result") & c("speaks")).drop("speaks")


def looked_up(pairs: DataFrame, evidence: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs (src, dst, and the titles, abstracts and authors) with what a source has on them: evidence by pair (contexts, intents,
    influential), lists by citing work (src, state: listed, no_id, unknown or failed). lookup tells listed, not_listed, no_id,
    citing_unknown or fetch_failed; found is true for listed pairs only."""
    has = evidence.select("src", "dst", "contexts", "intents", "influential", F.lit(True).alias("_has")).dropDuplicates(["src", "dst"])
    states = lists.groupBy("src").agg(F.min("state").alias("_state"))
    out = pairs.join(has, ["src", "dst"], "left").join(states, "src", "left")
    lookup = F.when(F.col("_has"), "listed").when(F.col("_state") == "listed", "not_listed").when(F.col("_state") == "no_id", "no_id").when(F.col("_state") == "unknown", "citing_unknown").otherwise("fetch_failed")
    return out.withColumn("lookup", lookup).withColumn("found", F.coalesce("_has", F.lit(False))).drop("_has", "_state")
