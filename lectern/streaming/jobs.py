"""Streams over landed events, and folds of keyed state.

Each stream writes to a table in the shared folder with its own checkpoint, processes what has landed and stops; run
again, it goes on where it stopped.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.storage import shared_dir
from lectern.streaming.folds import ordered_fold


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a landed table: a folder of files, or one file of a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}" + "*")


def drained(stream: DataFrame, label: str, mode: str) -> DataFrame:
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    out = f"{base}/table"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def hour_counts(spark: SparkSession, path: str) -> DataFrame:
    """Tumbling hours per event type."""
    hours = landed(spark, path).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    found = drained(hours.select(F.col("window.start").alias("hour"), "event_type", "n"), "hours", "update")
    return found.groupBy("hour", "event_type").agg(F.max("n").alias("n"))


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """Each key once, however late a row comes: the keys seen are the state, which grows with the keys only."""
    keys = landed(spark, path).select("user_id").dropDuplicates(["user_id"])
    return drained(keys, "seen", "append").distinct()


def leases(moves: DataFrame, hours: int) -> DataFrame:
    """(event_id, outcome) of moves(user_id, event_id, ts, owner, done): a claim is granted if no live one holds the key;
    a release takes it back if its owner makes it."""
    span = pd.Timedelta(hours=hours)

    def step(state: tuple, row) -> tuple[tuple, str]:
        owner, until = state
        if row.done:
            return ((None, None), "released") if owner == row.owner and owner is not None else (state, "not_owner")
        if owner is not None and until > row.ts:
            return state, "held"
        return (row.owner, row.ts + span), "claimed"

    return ordered_fold(moves, "user_id", ["ts", "event_id"], (None, None), step, ["event_id"], "outcome", "string")
