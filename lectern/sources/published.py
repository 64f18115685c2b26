"""A published catalog in two phases: rows are staged and validated, then one small commit makes them visible.

Under ``root``: ``data/<version>`` holds staged rows by conference, ``index/<version>`` one row a conference with the
version its rows lie in, and ``commits/<n>`` a file that names a version. A commit is created only where its number is
free, so of two publishers at once one fails and nothing is mixed. Readers follow the highest commit. What was staged and
refused is removed; what a killed job left behind is never named by a commit, so no reader sees it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_INDEX = "conference string, version string, papers long, orals long"


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, root: str) -> list[str]:
    """The names of the commits, oldest first; one a publication."""
    path, fs = _path(spark, f"{root}/commits")
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def head(spark: SparkSession, root: str) -> int:
    """The number of the last commit, 0 if there is none."""
    names = _commits(spark, root)
    return int(names[-1]) if names else 0


def _version(spark: SparkSession, root: str, number: int) -> str:
    return spark.read.text(f"{root}/commits/{number:08d}").first()[0]


def _commit(spark: SparkSession, root: str, number: int, version: str) -> None:
    path, fs = _path(spark, f"{root}/commits/{number:08d}")
    out = fs.create(path, False)
    out.write(bytearray(version.encode()))
    out.close()


def index(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """(conference, version, papers, orals) as of a commit, by default the last; empty before the first."""
    number = head(spark, root) if number is None else number
    if not number:
        return spark.createDataFrame([], _INDEX)
    return spark.read.schema(_INDEX).parquet(f"{root}/index/{_version(spark, root, number)}")


def _rows(spark: SparkSession, root: str, version: str) -> DataFrame:
    """A version's rows; conferences are texts, whatever their folders' names look like."""
    path = f"{root}/data/{version}"
    kinds = spark.read.parquet(path).schema
    texts = StructType([StructField(f.name, StringType() if f.name == "conference" else f.dataType) for f in kinds])
    return spark.read.schema(texts).parquet(path).withColumn("version", F.lit(version))


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The rows that a commit, by default the last, makes visible; None before the first. Each conference's rows come from
    the version its index names; a conference's folder of any other version is not read."""
    number = head(spark, root) if number is None else number
    if not number:
        return None
    entries = index(spark, root, number)
    versions = [r["version"] for r in entries.select("version").distinct().collect()]  # at most one a publication
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (_rows(spark, root, v) for v in versions))
    return rows.join(entries.select("conference", "version"), ["conference", "version"], "left_semi").drop("version")


def _faults(staged: DataFrame, before: DataFrame | None, whole: bool, allowed: tuple[str, ...], most_papers: int | None) -> DataFrame:
    """(conference, code, n) of staged rows against those visible now."""
    c = F.col
    every = staged.groupBy("conference").agg(F.count("*").alias("papers"), F.count_if(c("type") == "Oral").alias("orals"), F.count_if(~F.regexp(F.coalesce("paper_id", F.lit("")), F.lit("^[0-9a-f]{40}$"))).alias("bad"))
    found = [
        every.where(~F.regexp("conference", F.lit("^[a-z0-9][a-z0-9-]*$"))).select("conference", F.lit("slug").alias("code"), c("papers").alias("n")),
        every.where("bad > 0").select("conference", F.lit("paper_id").alias("code"), c("bad").alias("n")),
    ]
    if most_papers is not None:
        found.append(every.where(c("papers") > most_papers).select("conference", F.lit("too_many").alias("code"), c("papers").alias("n")))
    twice = staged.groupBy("conference", "paper_id").count().where("count > 1")
    found.append(twice.groupBy("conference").agg(F.count("*").alias("n")).select("conference", F.lit("duplicate").alias("code"), "n"))
    digests = staged.groupBy("paper_id").agg(F.min(F.sha2("abstract", 256)).alias("a"), F.max(F.sha2("abstract", 256)).alias("b"), F.min("conference").alias("conference")).where("a <> b")
    found.append(digests.groupBy("conference").agg(F.count("*").alias("n")).select("conference", F.lit("conflicting_abstracts").alias("code"), "n"))
    if before is not None:
        free = before.where(~c("conference").isin(*allowed)) if allowed else before
        old = free.select("conference", "paper_id", (c("type") == "Oral").alias("_o"), *((F.trim(F.coalesce(n, F.lit(""))) != "").alias(f"_{n}") for n in ("abstract", "authors")))
        new = staged.select("conference", "paper_id", F.lit(True).alias("_here"), *((F.trim(F.coalesce(n, F.lit(""))) != "").alias(f"_new_{n}") for n in ("abstract", "authors")))
        if not whole:
            old = old.join(every.select("conference"), "conference", "left_semi")
        was = old.groupBy("conference").agg(F.count("*").alias("p0"), F.count_if("_o").alias("o0")).join(every, "conference", "left")
        found += [
            was.where("papers is null").select("conference", F.lit("dropped").alias("code"), c("p0").alias("n")),
            was.where("papers < p0").select("conference", F.lit("fewer_papers").alias("code"), (c("p0") - c("papers")).alias("n")),
            was.where("orals < o0").select("conference", F.lit("fewer_orals").alias("code"), (c("o0") - c("orals")).alias("n")),
        ]
        met = old.join(new, ["conference", "paper_id"], "left").join(every.select("conference"), "conference", "left_semi")
        told = met.groupBy("conference").agg(F.count_if(c("_here").isNull()).alias("lost_ids"), *(F.count_if(c(f"_{n}") & ~c(f"_new_{n}")).alias(f"erased_{n}") for n in ("abstract", "authors")))
        found += [told.where(c(n) > 0).select("conference", F.lit(n).alias("code"), c(n).alias("n")) for n in ("lost_ids", "erased_abstract", "erased_authors")]
    return reduce(DataFrame.unionByName, found)


def publish(rows: DataFrame, root: str, *, whole: bool = True, allow_shrink: tuple[str, ...] = (), most_papers: int | None = None) -> list[tuple[str, str, int]]:
    """Publishes rows(conference, paper_id, type, abstract, authors, ...) or, if they break a rule, nothing; gives the faults
    (conference, code, n), at most a few a conference. ``whole``: conferences that are visible and not among the rows are a
    fault; else they stay as they are. ``allow_shrink`` names conferences that may lose rows, ids, orals and contents.

    A null or blank conference is a fault of slug, told as ''. Equal rows twice are a duplicate. Empty rows publish nothing
    where nothing is visible, and are a fault of every conference where something is."""
    spark = rows.sparkSession
    version, base = uuid.uuid4().hex, head(spark, root)
    data, entries = f"{root}/data/{version}", f"{root}/index/{version}"
    named = rows.withColumn("conference", F.coalesce("conference", F.lit("")))
    # rows of an empty conference lie in a folder of the default name, which reads back as null
    named.hint("rebalance", F.col("conference")).write.mode("errorifexists").partitionBy("conference").parquet(data)
    staged = spark.read.schema(named.schema).parquet(data).withColumn("conference", F.coalesce("conference", F.lit("")))
    faults = [(r["conference"], r["code"], r["n"]) for r in _faults(staged, current(spark, root), whole, allow_shrink, most_papers).collect()]
    if faults:
        path, fs = _path(spark, data)
        fs.delete(path, True)
        return sorted(faults)
    fresh = staged.groupBy("conference").agg(F.count("*").alias("papers"), F.count_if(F.col("type") == "Oral").alias("orals")).withColumn("version", F.lit(version))
    if not whole:
        fresh = fresh.unionByName(index(spark, root, base).join(fresh.select("conference"), "conference", "left_anti"))
    fresh.select("conference", "version", "papers", "orals").write.mode("errorifexists").parquet(entries)
    _commit(spark, root, base + 1, version)
    return []


def rollback(spark: SparkSession, root: str, number: int) -> None:
    """A new commit makes an earlier one's rows visible again; no file is touched."""
    _commit(spark, root, head(spark, root) + 1, _version(spark, root, number))
