"""Catalog filters, gates and upkeep as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import term_variants


def facet_filter(types: Column, tags: Column, abstract: Column, haystack: Column, kind: str | None = None, any_tags: list[str] = (), with_abstract: bool = False, terms: list[str] = ()) -> Column:
    """A type, any of some tags, an abstract, and every term (or one of its plural variants) in the haystack."""
    conditions = [F.lit(True)]
    if kind:
        conditions.append(types == kind)
    if any_tags:
        conditions.append(F.arrays_overlap(tags, F.array(*map(F.lit, any_tags))))
    if with_abstract:
        conditions.append(F.trim(F.coalesce(abstract, F.lit(""))) != "")
    low = F.lower(haystack)
    conditions += [F.exists(term_variants(F.lit(t.lower())), lambda v: F.contains(low, v)) for t in terms]
    return reduce(lambda a, b: a & b, conditions)


def in_years(year: Column, low: int, high: int) -> Column:
    """An unknown year always passes."""
    return F.coalesce(year.between(low, high), F.lit(True))


def node_matches(title: Column, venue: Column, authors: Column, words: str) -> Column:
    """The words stand in the title, the venue or an author's name."""
    w = words.lower()
    some = F.contains(F.lower(title), F.lit(w)) | F.contains(F.lower(F.coalesce(venue, F.lit(""))), F.lit(w))
    return F.coalesce(some, F.lit(False)) | F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lit(w)))


def in_scope(dominant: Column, subfield: Column) -> Column:
    """No dominant subfield, an unknown one, or the same."""
    return F.coalesce(dominant == subfield, F.lit(True))


def off_topic(denied: Column, cites: Column, most_cited_seed: Column, intent: Column) -> Column:
    """Denied, or cited over twice as often as the most cited seed unless it is cited for its method."""
    return denied | (F.coalesce(cites > most_cited_seed * 2, F.lit(False)) & (F.coalesce(intent, F.lit("")) != "methodology"))


def chips(counts: DataFrame, group: str, tag: str, n: str, head: int) -> DataFrame:
    """(group, head, rest): the ``head`` most frequent tags in order, and how many further rows the others have."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), tag))
    ranked = counts.withColumn("_r", place)
    first = F.array_sort(F.collect_list(F.when(F.col("_r") <= head, F.struct(F.col("_r"), F.col(tag).alias("t")))))
    return ranked.groupBy(group).agg(F.transform(first, lambda x: x["t"]).alias("head"), F.coalesce(F.sum(F.when(F.col("_r") > head, F.col(n))), F.lit(0)).alias("rest"))


def edge_metrics(edges: DataFrame, graph: str, templates: list[str], sink: int = 8, least: int = 10) -> DataFrame:
    """Per graph of edges(graph, src, dst, src_year, dst_year, rationale, evidence): edges, those whose rationale is one of
    the templates and their share, those whose rationale is shorter than ``least`` characters but not empty and their share,
    sinks (nodes that ``sink`` or more edges without citation evidence lead to), and reversals (src over a year younger). A
    null rationale is empty, null evidence none, and an edge with a null year no reversal."""
    said = F.trim(F.coalesce("rationale", F.lit("")))
    template, short = said.isin(*templates), (F.char_length(said) > 0) & (F.char_length(said) < least)
    into = edges.where(~F.coalesce("evidence", F.lit(False)) & F.col("dst").isNotNull()).groupBy(graph, "dst").agg(F.count("*").alias("_n"))
    sinks = into.groupBy(graph).agg(F.count_if(F.col("_n") >= sink).alias("sinks"))
    counts = edges.groupBy(graph).agg(
        F.count("*").alias("edges"), F.count_if(template).alias("template"), F.avg(F.when(template, 1.0).otherwise(0.0)).alias("template_ratio"),
        F.count_if(short).alias("short"), F.avg(F.when(short, 1.0).otherwise(0.0)).alias("short_ratio"), F.count_if(F.col("src_year") > F.col("dst_year") + 1).alias("reversals"))
    return counts.join(sinks, graph, "left").withColumn("sinks", F.coalesce("sinks", F.lit(0)))


def off_topic_share(nodes: DataFrame, graph: str, samples: int = 5) -> DataFrame:
    """Per graph of nodes(graph, id, is_focus, foundational, on_topic): the share of off-topic nodes among those that are
    neither in focus nor foundational, and the first few."""
    judged = nodes.where(~F.col("is_focus") & ~F.col("foundational"))
    place = F.row_number().over(Window.partitionBy(graph).orderBy("on_topic", "id"))
    told = judged.withColumn("_r", F.when(~F.col("on_topic"), place))
    return told.groupBy(graph).agg(F.avg(F.when(F.col("on_topic"), 0.0).otherwise(1.0)).alias("share"), F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, F.col("id")))).alias("samples"))


def catalog_gate(before: DataFrame, after: DataFrame, key: str, kind: Column, least: float) -> DataFrame:
    """One row: rows, orals and distinct contents before and after, ids lost, and whether the new catalog is refused: fewer
    rows or orals than the share, a lost id, or contents that collapsed into fewer."""
    def told(df: DataFrame, when: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"rows_{when}"), F.count_if(kind).alias(f"orals_{when}"), F.countDistinct("content").alias(f"contents_{when}"))

    lost = before.select(key).join(after.select(key), key, "left_anti").agg(F.count("*").alias("lost"))
    one = told(before, "before").crossJoin(told(after, "after")).crossJoin(lost)
    short = reduce(lambda a, b: a | b, (F.col(f"{n}_after") < F.col(f"{n}_before") * least for n in ("rows", "orals", "contents")))
    return one.withColumn("refused", short | (F.col("lost") > 0))


def set_losses(before: DataFrame, after: DataFrame, kinds: list[str], parts: int | None = None) -> DataFrame:
    """(kind, lost, gained) of two tables of (kind, item): focus papers, nodes or edges that an expansion loses. Items of any
    type meet in ``parts`` parts, by default the session's."""
    both = before.select("kind", "item", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("kind", "item", F.lit(0).alias("b"), F.lit(1).alias("a")))
    both = both if parts is None else both.repartition(parts, "kind", "item")
    sides = both.groupBy("kind", "item").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return sides.where(F.col("kind").isin(kinds)).groupBy("kind").agg(F.sum(F.when(F.col("a") == 0, 1).otherwise(0)).alias("lost"), F.sum(F.when(F.col("b") == 0, 1).otherwise(0)).alias("gained"))


def compacted(cache: DataFrame, live: DataFrame, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """The cached rows both of whose ends are live."""
    out = cache
    for end in ends:
        out = out.join(live.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return out.select(*cache.columns)


def purged(cache: DataFrame, templates: list[str], column: str = "rationale") -> DataFrame:
    """The cached rows whose rationale is no template's."""
    return cache.where(~reduce(lambda a, b: a | b, (F.regexp(F.coalesce(column, F.lit("")), F.lit(t)) for t in templates)))


def stale(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """(key, state): rows of a stored index that recomputing gives otherwise, no more, or anew."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.sha2(F.to_json(F.struct(*(c for c in sorted(df.columns) if c != key))).cast("binary"), 256).alias(name))

    both = digest(stored, "_s").join(digest(fresh, "_f"), key, "full_outer")
    state = F.when(F.col("_s").isNull(), "missing").when(F.col("_f").isNull(), "left_over").when(F.col("_s") != F.col("_f"), "changed")
    return both.select(key, state.alias("state")).where("state is not null")


def audit_outcome(rows: DataFrame, group: str) -> DataFrame:
    """Per group of rows(group, human, suggested, sampled, off_topic): verdicts by a person, else as suggested; unset and
    wrong ones, and the rate of off-topic among those sampled."""
    verdict = F.coalesce(F.nullif("human", F.lit("")), F.nullif("suggested", F.lit("")))
    return rows.groupBy(group).agg(
        F.count_if(verdict.isNull()).alias("unset"), F.count_if(verdict == "wrong").alias("wrong"), (F.count_if(F.col("sampled") & F.col("off_topic")) / F.greatest(F.count_if("sampled"), F.lit(1))).alias("off_topic_rate"))


def regressions(before: DataFrame, after: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, reason) of before and after (key, tier, nodes): a lower tier, under half of the nodes, or gone."""
    place = F.create_map(*(x for k, t in enumerate(order) for x in (F.lit(t), F.lit(k))))
    both = before.select(key, F.col("tier").alias("t0"), F.col("nodes").alias("n0")).join(after.select(key, F.col("tier").alias("t1"), F.col("nodes").alias("n1")), key, "left")
    reason = F.when(F.col("n1").isNull(), "gone").when(place[F.col("t1")] > place[F.col("t0")], "tier").when(F.col("n1") * 2 < F.col("n0"), "nodes")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def index_faults(rows: DataFrame, low: int = 1900, high: int = 2200) -> DataFrame:
    """(ordinal, faults) of index rows(title, conference, ordinal, authors, tags, year, type) that break the contract: a blank
    title, a conference that is no slug, an ordinal that is not the row's place in (conference, title), lists that are null
    or hold null, a year out of range (null is none), another type than Oral and Poster."""
    from lectern.operators.ordinals import sorted_ordinal

    def broken(name: str) -> Column:
        return F.col(name).isNull() | F.exists(name, lambda x: x.isNull())

    placed = sorted_ordinal(rows.withColumnRenamed("ordinal", "told"), ["conference", "title", "told"])
    faults = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title"), F.when(~F.regexp(F.coalesce("conference", F.lit("")), F.lit("^[a-z0-9][a-z0-9-]*$")), "conference"), F.when(~F.col("told").eqNullSafe(F.col("ordinal")), "ordinal"),
        F.when(broken("authors"), "authors"), F.when(broken("tags"), "tags"), F.when(~F.coalesce(F.col("year").between(low, high), F.lit(True)), "year"), F.when(~F.coalesce(F.col("type").isin("Oral", "Poster"), F.lit(False)), "type"),
    ))
    return placed.select(F.col("told").alias("ordinal"), faults.alias("faults")).where("size(faults) > 0")


def worst_page(rows: DataFrame, order: list[str], size: Column, page: int) -> DataFrame:
    """One row: rows, and the largest page in bytes when rows are served in this order."""
    from lectern.operators.ordinals import sorted_ordinal

    pages = sorted_ordinal(rows.withColumn("_size", size), order).groupBy(F.floor(F.col("ordinal") / page).alias("_page")).agg(F.count("*").alias("n"), F.sum("_size").alias("bytes"))
    return pages.agg(F.sum("n").alias("rows"), F.max("bytes").alias("worst"))
