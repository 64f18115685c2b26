"""Cutting long plans by writing to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary folder,
    removed at the end; on a cluster, whose executors would each write to a disk of their own, that is an error."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many parts as a shuffle has, by ``keys``. A join that gives many rows for few bytes would else run in the
    few parts that those bytes are merged to."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parts_of(rows: int, each: int = 500_000) -> int | None:
    """How many parts of at most ``each`` rows so many rows need; null if the session's shuffle partitions are enough."""
    from pyspark.sql import SparkSession

    needed = -(-rows // each)
    return needed if needed > int(SparkSession.active().conf.get("spark.sql.shuffle.partitions")) else None


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized frame that no plan reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        if f"{folder}/".replace("file:///", "/").startswith(f"{root}/".replace("file://", "")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
