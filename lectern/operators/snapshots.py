"""Snapshots of landed rows: a digest bound to order and content, and what a snapshot's rows and header break."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.contracts import _codes, _said
from lectern.operators.ordinals import sorted_ordinal

_SALTS = 32


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``place``, 0.. within the group. The groups' starts are told once a salt, so a group with a third of all rows is
    joined in many tasks."""
    numbered = sorted_ordinal(rows, [group, *order]).withColumn("_salt", F.col("ordinal") % _SALTS)
    starts = numbered.groupBy(group).agg(F.min("ordinal").alias("_start")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<bigint>")))
    return numbered.join(starts, [group, "_salt"]).withColumn("place", F.col("ordinal") - F.col("_start")).drop("_salt", "_start", "ordinal")


def ordered_digests(rows: DataFrame, group: str, order: list[str], content: list[str], block: int = 1000, levels: int = 3) -> DataFrame:
    """(group, digest, n_rows): SHA-256 of each group's rows in order. A row's digest is that of its columns as text, each
    ``-`` if null, else its length in bytes, a colon and itself; runs of ``block`` digests become the digest of their
    hexadecimal texts, ``levels`` times. No task holds more than ``block`` digests. Rows without a group are left out;
    rows of equal order must be equal too, or the digest is not defined; over block ** levels rows are an error."""
    def cell(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    slim = rows.where(F.col(group).isNotNull()).select(group, *order, F.sha2(F.concat(*map(cell, content)).cast("binary"), 256).alias("d"))
    level = places(slim, group, order).select(group, "place", "d", F.lit(1).cast("long").alias("n"))
    most = F.lit(block**levels)
    level = level.withColumn("place", F.when(F.col("place") < most, F.col("place")).otherwise(F.raise_error(F.lit("too many rows for the levels of the digest")).cast("long")))
    for _ in range(levels):
        runs = level.groupBy(group, F.floor(F.col("place") / block).alias("_run")).agg(F.array_sort(F.collect_list(F.struct("place", "d"))).alias("ds"), F.sum("n").alias("n"))
        joined = F.array_join(F.transform("ds", lambda x: x["d"]), "")
        level = runs.select(group, F.col("_run").alias("place"), F.sha2(joined.cast("binary"), 256).alias("d"), "n")
    return level.select(group, F.col("d").alias("digest"), F.col("n").alias("n_rows"))


def snapshot_faults(headers: DataFrame, rows: DataFrame, expected_id: Column, landing: str, labels: tuple[str, ...], content: list[str], *, most_rows: int = 25_000, most_bytes: int = 128 << 20, most_authors: int = 512) -> DataFrame:
    """(snapshot, code, path) of headers(snapshot, duplicate_titles, unknown, fingerprint), ``unknown`` an array of (label, n),
    and rows(snapshot, pos, source_id, paper_id, url, title, abstract, decision, authors).

    Rows: an id of its own form that gives the paper's id and URL, a title and a decision that say something, lengths, 1 to
    ``most_authors`` authors without commas and semicolons. Snapshots: repeated ids or URLs, rows out of the order of their
    ids, how many rows and bytes, the counts of titles that repeat and of decisions that are none of ``labels`` (lower-cased)
    against the header's, whose labels must ascend, and the digest of ``content`` in stored order. A snapshot without rows
    breaks the count of rows; rows of no header are told as ``header_missing``. Null texts count as empty."""
    c = F.col

    def long_(name: str, most: int) -> Column:
        return F.char_length(F.coalesce(name, F.lit(""))) > most

    identity = ~F.coalesce(F.regexp("source_id", F.lit("^[A-Za-z0-9_-]{1,256}$")) & (c("paper_id") == expected_id) & (c("url") == F.concat(F.lit(landing), "source_id")), F.lit(False))
    count = F.coalesce(F.size("authors"), F.lit(0))
    row_codes = _codes(
        ("row_identity", identity), ("title", ~_said(c("title")) | long_("title", 10_000)), ("abstract", long_("abstract", 100_000)), ("decision_label", ~_said(c("decision")) | long_("decision", 1_000)),
        ("authors", ~count.between(1, most_authors)), ("author", F.exists("authors", lambda a: ~_said(a) | (F.char_length(a) > 1_000))), ("author_delimiter", F.exists("authors", lambda a: F.regexp(a, F.lit("[,;]")))),
    )
    faults = [rows.select("snapshot", F.explode(row_codes).alias("code"), F.coalesce("source_id", F.lit("")).alias("path"))]

    for name in ("source_id", "paper_id", "url"):
        again = rows.where(c(name).isNotNull()).groupBy("snapshot", name).count().where("count > 1")
        faults.append(again.select("snapshot", F.lit("duplicate_id").alias("code"), F.concat(F.lit(f"{name}:"), name).alias("path")))

    here = rows.select("snapshot", c("pos").alias("_p"), c("source_id").alias("_a"))
    after = rows.select("snapshot", (c("pos") - 1).alias("_p"), c("source_id").alias("_b"))
    faults.append(here.join(after, ["snapshot", "_p"]).where("_a > _b").select("snapshot").distinct().select("snapshot", F.lit("row_order").alias("code"), F.lit("rows").alias("path")))

    size = reduce(lambda a, b: a + b, (F.octet_length(F.coalesce(n, F.lit(""))) for n in ("title", "abstract", "decision"))) + F.octet_length(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ""))
    label = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    titles = rows.groupBy("snapshot", "title").count().groupBy("snapshot").agg(F.sum(c("count") - 1).alias("_twice"))
    odd = rows.where(~label.isin(*labels)).groupBy("snapshot", label.alias("label")).agg(F.count("*").alias("n"))
    odd = odd.groupBy("snapshot").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("_unknown"))
    totals = rows.groupBy("snapshot").agg(F.count("*").alias("_rows"), F.sum(size.cast("long")).alias("_bytes"))
    digests = ordered_digests(rows, "snapshot", ["pos"], content).select("snapshot", "digest")
    every = headers.join(totals, "snapshot", "left").join(titles, "snapshot", "left").join(odd, "snapshot", "left").join(digests, "snapshot", "left")
    told = F.coalesce(c("unknown"), F.array().cast("array<struct<label:string,n:bigint>>"))
    found = F.coalesce(c("_unknown"), F.array().cast("array<struct<label:string,n:bigint>>"))
    names = F.transform(told, lambda x: x["label"])
    snapshot_codes = _codes(
        ("rows", ~F.coalesce("_rows", F.lit(0)).between(1, most_rows)), ("text_bytes", c("_bytes") > most_bytes), ("unknown_decisions", (names != F.array_sort(F.array_distinct(names))) | F.exists(names, lambda x: x != F.lower(x))),
        ("statistics", (F.transform(told, lambda x: F.concat(x["label"], F.lit("="), x["n"])) != F.transform(found, lambda x: F.concat(x["label"], F.lit("="), x["n"]))) | ~c("duplicate_titles").eqNullSafe(F.coalesce("_twice", F.lit(0)))),
        ("fingerprint", ~c("fingerprint").eqNullSafe(c("digest"))),
    )
    faults.append(every.select("snapshot", F.explode(snapshot_codes).alias("code"), F.lit("header").alias("path")))
    faults.append(rows.select("snapshot").distinct().join(headers, "snapshot", "left_anti").select("snapshot", F.lit("header_missing").alias("code"), F.lit("header").alias("path")))
    return reduce(DataFrame.unionByName, faults)
