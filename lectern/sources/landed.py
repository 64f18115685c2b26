"""Readers of landed responses: CSV, JSON, XML, HTML and BibTeX. Schemas are given, bad records are set apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import collapse, strip_tags

CORRUPT = "_corrupt_record"
WORKS = "id string, title string, year int, authorships array<struct<name: string>>, abstract_inverted_index map<string, array<int>>"
NOTES = "id string, content struct<title: struct<value: string>, authors: struct<value: array<string>>, venueid: struct<value: string>>"
ATOM = "id string, title string, summary string, published string, author array<struct<name: string>>, category array<struct<_term: string>>"


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted newlines and doubled quotes are text; short rows are filled with nulls, further cells dropped,
    blank rows skipped. A file keeps to one kind of line end."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")


def json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, texts of those that do not)."""
    raw = spark.read.text(path)
    both = raw.select("value", F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return both.where(~bad).select("r.*").drop(CORRUPT), both.where(bad).select("value")


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)


def versioned(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """A cache's rows of one schema version; others count as absent."""
    return spark.read.schema(f"{schema}, schema_version int").json(path).where(F.col("schema_version") == version).drop("schema_version")


def listing_rows(pages: DataFrame, block: str, fields: dict[str, str], html: str = "html", key: str | None = None) -> DataFrame:
    """One row per match of a block pattern in a listing page, its fields by pattern. With a ``key`` field, blocks that
    lack a field are malformed and left out, and of repeated keys of a page the first stays."""
    own = [c for c in pages.columns if c != html]
    blocks = pages.select(*own, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(block), F.lit(0))).alias("pos", "_block"))
    rows = blocks.select("*", *(collapse(F.regexp_extract("_block", p, 1)).alias(n) for n, p in fields.items())).drop("_block")
    if key is None:
        return rows
    whole = rows.where(" and ".join(f"`{n}` <> ''" for n in fields))
    rest = [c for c in whole.columns if c not in (*own, key)]
    first = whole.groupBy(*own, key).agg(F.min_by(F.struct(*rest), "pos").alias("_f"))
    return first.select(*own, key, *(F.col(f"_f.{c}") for c in rest))


def anthology_papers(spark: SparkSession, path: str, collection: str, volumes: list[str]) -> DataFrame:
    """(stub, title, authors) of an anthology's XML: papers with a title and authors in the main volumes, by their own
    children only; the stub is made of collection, volume and paper, the first of repeated stubs stays."""
    person = "struct<first: string, last: string>"
    whole = spark.read.format("xml").option("rowTag", "volume").schema(f"_id string, paper array<struct<_id: string, title: string, author: array<{person}>>>").load(path)
    rows = whole.where(F.col("_id").isin(volumes)).select(F.col("_id").alias("volume"), F.posexplode("paper").alias("pos", "p"))
    names = F.filter(F.transform(F.coalesce("p.author", F.array().cast(f"array<{person}>")), lambda a: F.trim(F.concat_ws(" ", a["first"], a["last"]))), lambda n: n != "")
    papers = rows.select(F.concat(F.lit(f"{collection}-"), "volume", F.lit("."), "p._id").alias("stub"), "pos", F.col("p.title").alias("title"), names.alias("names")).where((F.coalesce("title", F.lit("")) != "") & (F.size("names") > 0))
    return papers.groupBy("stub").agg(F.min_by(F.struct("title", F.array_join("names", "; ").alias("authors")), "pos").alias("f")).select("stub", "f.title", "f.authors")


def bibliography_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, title, venue, year, authors) of a query answer's bindings, each a struct of a text value."""
    value = "struct<value: string>"
    rows, _ = json_rows(spark, path, f"pub {value}, title {value}, venue {value}, year {value}, authors {value}")
    return rows.select(
        F.regexp_replace("pub.value", "^https://dblp\\.org/rec/", "").alias("key"), F.col("title.value").alias("title"), F.col("venue.value").alias("venue"), F.col("year.value").try_cast("int").alias("year"),
        F.filter(F.split(F.coalesce("authors.value", F.lit("")), "\\|"), lambda a: a != "").alias("authors"))


def alias_claims(rows: DataFrame) -> DataFrame:
    """(namespace, value, first, claims, unique_claim) of rows(namespace, value, paper): how many papers an alias names."""
    return rows.groupBy("namespace", "value").agg(F.min("paper").alias("first"), F.countDistinct("paper").alias("claims")).withColumn("unique_claim", F.col("claims") == 1)


def flipped_names(cell):
    """Names of a cell as First Last: parted by " and " or semicolons, each turned round at its comma."""
    names = F.split(cell, r"\s+and\s+|\s*;\s*")
    return F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"^\s*([^,]+),\s*(.+?)\s*$", "$2 $1"))), lambda n: n != "")


def context_sentences(pages: DataFrame, cue: str, most: int = 5, html: str = "html") -> DataFrame:
    """(…, pos, sentence): the first sentences of a page's text that hold the cue."""
    sentences = F.filter(F.split(strip_tags(F.col(html)), r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lit(cue)))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.slice(sentences, 1, most)).alias("pos", "sentence"))


def _bib_fields(entry: str) -> dict[str, str]:
    """Fields of one entry; values nest braces to any depth or stand in quotes."""
    out, at = {}, entry.find(",") + 1
    while (eq := entry.find("=", at)) >= 0:
        name, at = entry[at:eq].strip(" ,\n\t").lower(), eq + 1
        while at < len(entry) and entry[at].isspace():
            at += 1
        if at >= len(entry):
            break
        start, depth = at + 1, 0
        if entry[at] == "{":
            for at in range(at, len(entry)):
                depth += (entry[at] == "{") - (entry[at] == "}")
                if not depth:
                    break
            out[name] = entry[start:at]
        elif entry[at] == '"':
            at = entry.find('"', start)
            at = len(entry) if at < 0 else at
            out[name] = entry[start:at]
        else:
            start, at = at, min((p for p in (entry.find(",", at), entry.find("}", at)) if p >= 0), default=len(entry))
            out[name] = entry[start:at].strip()
        at += 1
    return out


def bibtex_fields(entries: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Adds the named fields of BibTeX entries; brace depth is beyond patterns, so batches go through Python."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema), *(f"{n} string" for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_bib_fields(e or "") for e in batch[column]]
            yield batch.assign(**{n: [f.get(n) for f in found] for n in names})

    return entries.mapInPandas(run, schema)


def source_status(rows: DataFrame, source: str, keyword: str, total: str, seen: str) -> DataFrame:
    """Completeness per source and keyword: fewer rows than announced is truncated, none announced is degraded."""
    counted = rows.groupBy(source, keyword).agg(F.max(total).alias("total"), F.sum(seen).alias("seen"))
    return counted.withColumn("status", F.when(F.col("total").isNull(), "degraded").when(F.col("seen") < F.col("total"), "truncated").otherwise("complete"))
