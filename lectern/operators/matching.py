"""Similarity joins of texts without pairs of all that share a block."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import single_word_typo
from lectern.plans.storage import materialize


# Sets up to this size meet by several items at once, of up to so many combinations a pair of sizes.
_SMALL, _COMBINATIONS = 24, 70


def _picks(over: int, under: int) -> list[tuple]:
    """(n, m, i, j, l): the places that a set of n items, rare ones first, is looked up by among sets of m items.

    Two such sets share ``least`` items or more, so ``k`` of these lie in the first ``n - least + k`` of one and the first
    ``m - least + k`` of the other.
    """
    out = []
    for n in range(1, _SMALL + 1):
        for m in range(-(-n * over // under), min(_SMALL, n * under // over) + 1):
            least = -(-over * (n + m) // (over + under))
            k = max(k for k in (1, 2, 3) if k == 1 or (k <= least and comb(max(n, m) - least + k, k) <= _COMBINATIONS))
            out += [(n, m, *c, *[None] * (3 - k)) for c in combinations(range(n - least + k), k)]
    return out


def similar_sets(sets: DataFrame, over: int, under: int) -> DataFrame:
    """(a, b, score): pairs of ids, a < b, whose distinct ``items`` have a Jaccard similarity of over/under or more.

    A prefix filter: items have one order, rare ones first, and two such sets share one of the first
    ``n - ceil(n * over / under) + 1``; only their rarest items are joined, so common ones cost nothing. Small sets meet by up
    to three shared items of somewhat longer prefixes, so that one common word brings none together. Sizes that can't
    be similar are left out, and pairs are verified by their sets. No pair is missed. Empty sets have none.
    """
    own = materialize(sets.select("id", F.array_distinct("items").alias("items")), "set-own")
    items = own.select("id", F.explode("items").alias("item"))
    placed = items.join(items.groupBy("item").agg(F.count("*").alias("df")), "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("x"))
    ordered = materialize(placed.select("id", F.col("x.item").alias("items")).withColumn("n", F.size("items")), "set-ordered")
    picks = F.broadcast(sets.sparkSession.createDataFrame(_picks(over, under), "n int, m int, i int, j int, l int").join(ordered.select(F.col("n").alias("m")).distinct(), "m"))
    key = F.xxhash64(*(F.get("items", F.col(c)) for c in "ijl"))
    keyed = materialize(ordered.where(F.col("n") <= _SMALL).join(picks, "n").select("id", "n", "m", key.alias("key")), "set-keys")
    a, b = keyed.withColumnRenamed("id", "a"), keyed.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("m").alias("n"), "key")
    near = a.join(b, ["key", "n", "m"]).where("a < b").select("a", "b")
    long = ordered.where(F.col("n") * under >= F.lit(_SMALL + 1) * over)
    prefix = long.select("id", F.explode(F.slice("items", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(over) / F.lit(under)) + 1).cast("int"))).alias("item"), "n")
    a, b = prefix.select(F.col("id").alias("a"), "item", F.col("n").alias("n_a")), prefix.select(F.col("id").alias("b"), "item", F.col("n").alias("n_b"))
    sizes = (F.greatest("n_a", "n_b") > _SMALL) & (F.col("n_a") * over <= F.col("n_b") * under) & (F.col("n_b") * over <= F.col("n_a") * under)
    near = near.unionByName(a.join(b, "item").where((F.col("a") < F.col("b")) & sizes).select("a", "b")).distinct()
    both = near.join(own.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    measured = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("union"))
    return measured.where(F.col("shared") * under >= F.col("union") * over).select("a", "b", (F.col("shared") / F.col("union")).alias("score"))


def contained_names(names: DataFrame, block: list[str]) -> DataFrame:
    """(*block, inner, outer) of distinct names(*block, name): names of one block whose words, all different, are all among
    the outer's. A name is looked up by its rarest word only; no pair is missed, and each name is its own outer."""
    words = names.withColumn("w", F.split("name", " "))
    each = words.select(*block, "name", "w", F.explode(F.array_distinct("w")).alias("word"))
    rare = each.join(each.groupBy(*block, "word").agg(F.count("*").alias("df")), [*block, "word"]).groupBy(*block, "name").agg(F.min_by("word", F.struct("df", "word")).alias("word"), F.first("w").alias("iw"))
    both = rare.withColumnRenamed("name", "inner").join(each.withColumnsRenamed({"name": "outer", "w": "ow"}), [*block, "word"])
    return both.where(F.size(F.array_intersect("iw", "ow")) == F.size("iw")).select(*block, "inner", "outer")


def typo_pairs(titles: DataFrame) -> DataFrame:
    """(a, b): distinct titles, each named by its least id, that differ in one word as ``single_word_typo`` has it.

    Titles meet under what is left when one long word is taken out, with its place, so only those that agree in all
    other words are compared.
    """
    distinct = materialize(titles.groupBy("title").agg(F.min("id").alias("id")), "typo-titles")
    words = distinct.withColumn("w", F.split("title", " ")).where(F.size("w") >= 4)
    keyed = words.select("id", "title", F.posexplode("w").alias("pos", "word"), "w").where(F.char_length("word") >= 7)
    rest = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("pos")), F.slice("w", F.col("pos") + 2, F.size("w")))
    keyed = keyed.select("id", "title", "pos", rest.alias("rest"))
    a, b = (keyed.select(F.col("id").alias(n), F.col("title").alias(f"title_{n}"), "pos", "rest") for n in "ab")
    return a.join(b, ["pos", "rest"]).where((F.col("a") < F.col("b")) & single_word_typo(F.col("title_a"), F.col("title_b"))).select("a", "b")
