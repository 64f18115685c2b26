"""Sharding by a permutation-filled lookup table (Eisenbud et al., 2016).

Each shard prefers the slots of a prime-sized table in an order of its own: slot ``(offset + j * skip) mod size``, with
offset and skip taken from its name's MD5. Shards take turns, each claiming the first slot of its order that is free,
until the table is full. A key goes to slot ``hash mod size`` and so to that slot's shard. Slots are shared out evenly,
and taking a shard away moves little besides its own keys.

The table has ``size`` rows, a parameter of at most MAX_SLOTS, so it is always small enough to broadcast; placing a
key is one hash and one probe. The keys' path is DataFrame functions only.

Defined cases: a null key is placed as the empty text; equal keys go together; a key column of any type is placed by
its text; an empty table has no rows; the result has the key and its place, so other columns can't clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 20


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard number of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _prime(size) or not len(shards) <= size <= MAX_SLOTS:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_SLOTS}")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at, skip = [int(d[:8], 16) % size for d in digests], [int(d[8:16], 16) % (size - 1) + 1 for d in digests]
    owner: list[int | None] = [None] * size
    for turn in range(size):
        k = turn % len(shards)
        while owner[at[k]] is not None:
            at[k] = (at[k] + skip[k]) % size
        owner[at[k]] = k
    return owner


def table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard)."""
    return spark.createDataFrame([(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, size))], "slot int, shard string")


def slot(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], size: int = 65537) -> DataFrame:
    """(key, slot, shard) of each row."""
    keyed = rows.select(F.col(key).alias("key")).withColumn("slot", slot(F.col("key"), size))
    return keyed.join(F.broadcast(table(rows.sparkSession, shards, size)), "slot").select("key", "slot", "shard")
