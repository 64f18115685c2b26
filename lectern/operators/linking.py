"""Linking catalog rows to another bibliography in three passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import compact_key, single_word_typo, surname, title_score
from lectern.plans.storage import materialize, spread

_FEW = 5


def accepted(score: Column, overlap: Column, id_linked: Column | None = None) -> Column:
    """Titles agree at 0.9 (0.5 where an identifier links the records) and half of the authors are shared."""
    least = F.lit(0.9) if id_linked is None else F.when(id_linked, 0.5).otherwise(0.9)
    return (score >= least) & (overlap >= 0.5)


def link(rows: DataFrame, records: DataFrame, block: Column | None = None) -> DataFrame:
    """(id, record, pass) for rows(id, title, authors) and records(record, title, authors).

    First equal titles by key, and titles of the same block one mistyped word apart, judged by title and authors; the
    best by (title, authors, record) wins. Then equal author lists that are unique on both sides with a quarter of the
    title. Last, titles that are unique on both sides among what is left. ``block`` keeps fuzzy pairs inside a key; by
    default it is the title without its longest word.
    """
    def keyed(df: DataFrame) -> DataFrame:
        words = F.split(F.lower("title"), " ")
        longest = F.array_max(F.transform(words, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
        return df.withColumns({"k": compact_key(F.col("title")), "b": block if block is not None else F.array_join(F.filter(words, lambda w: w != longest), " "), "names": F.array_join(F.array_sort(F.transform("authors", F.lower)), "|")})

    a, b = (materialize(keyed(spread(df, key)), "link-keyed") for df, key in ((rows, "id"), (records, "record")))
    first = materialize(_best(a, b).withColumn("pass", F.lit(1)), "link-first")
    second = _unique(_left(a, [first], "id"), _left(b, [first], "record"), "names").where(title_score(F.col("title"), F.col("r_title")) >= 0.25).select("id", "record", F.lit(2).alias("pass"))
    second = materialize(second, "link-second")
    third = _unique(_left(a, [first, second], "id"), _left(b, [first, second], "record"), "k").select("id", "record", F.lit(3).alias("pass"))
    return first.unionByName(second).unionByName(third)


def _classes(df: DataFrame) -> DataFrame:
    """Rows with ``c`` (their block, marked so that none is no null) and ``who``, the sorted surnames (no surname: a blank that none has)."""
    who = F.array_sort(F.transform(F.array_distinct(F.transform("authors", surname)), lambda n: F.coalesce(n, F.lit(" "))))
    return df.withColumns({"c": F.coalesce(F.concat(F.lit("="), F.col("b")), F.lit("")), "who": who})


def _title_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(title, c, r_title, r_c, score) of titles of both sides that are equal by key or one mistyped word apart."""
    same = F.when(F.col("k") != "", F.col("k")).otherwise(F.concat(F.lit("="), F.col("title")))
    x, y = (materialize(df.select("title", "c", "k", same.alias("same")).where("title is not null").distinct(), "link-titles") for df in (a, b))
    y = y.select(*(F.col(n).alias(f"r_{n}") for n in y.columns))
    score = title_score(F.col("title"), F.col("r_title"))
    exact = x.join(y, F.col("same") == F.col("r_same")).where(score >= 0.9)
    typo = x.where("c <> ''").join(y, (F.col("c") == F.col("r_c")) & (F.col("k") != F.col("r_k"))).where(single_word_typo(F.lower("title"), F.lower("r_title")))
    return exact.unionByName(typo).select("title", "c", "r_title", "r_c", score.alias("score"))


def _subsets(df: DataFrame) -> DataFrame:
    """A row for each choice of surnames: ``s`` of them, joined as ``some``."""
    start = F.array(F.array().cast("array<string>"))
    every = F.aggregate("who", start, lambda all_, n: F.concat(all_, F.transform(all_, lambda one: F.concat(one, F.array(n)))))
    return df.withColumn("_x", F.explode(every)).where(F.size("_x") > 0).withColumns({"s": F.size("_x"), "some": F.array_join("_x", "\n")}).drop("_x")


def _best(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, record): each row's best record by (title, authors, record) among those that :func:`accepted` takes.

    Rows and records meet as classes of equal title and surnames, a record class as its first record. A class of at most
    ``_FEW`` surnames keeps the first record of each choice of them, so what two classes share is looked up, and never more
    than one record a choice; classes with more surnames meet the others by each surname, and shared ones are counted.
    """
    a, b = _classes(a), _classes(b)
    pairs = materialize(_title_pairs(a, b), "link-pairs")
    mine = a.select("title", "c", "who").where("size(who) > 0").distinct().withColumn("n", F.size("who"))
    mine = materialize(mine.join(pairs, ["title", "c"]), "link-rows")
    theirs = b.where("size(who) > 0").groupBy(F.col("title").alias("r_title"), F.col("c").alias("r_c"), "who").agg(F.min("record").alias("record")).withColumn("m", F.size("who"))
    theirs = materialize(theirs.join(pairs.select("r_title", "r_c").distinct(), ["r_title", "r_c"], "left_semi"), "link-records")
    place = ["r_title", "r_c"]

    held = _subsets(theirs.where(F.col("m") <= _FEW)).groupBy(*place, "some", "s", "m").agg(F.min("record").alias("record"))
    chosen = _subsets(mine.where(F.col("n") <= _FEW).withColumn("all", F.col("who"))).drop("s")
    few = chosen.join(held, [*place, "some"]).select("title", "c", F.col("all").alias("who"), "score", (F.col("s") / F.least("n", "m")).alias("overlap"), "record")

    def shared(x: DataFrame, y: DataFrame) -> DataFrame:
        left = x.select("title", "c", F.col("who").alias("all"), *place, "score", "n", F.explode("who").alias("one"))
        right = y.select(*place, "record", "m", F.col("who").alias("whose"), F.explode("who").alias("one"))
        met = left.join(right, [*place, "one"]).groupBy("title", "c", "all", *place, "score", "n", "m", "whose", "record").agg(F.count("*").alias("s"))
        return met.select("title", "c", F.col("all").alias("who"), "score", (F.col("s") / F.least("n", "m")).alias("overlap"), "record")

    many = shared(mine.where(F.col("n") > _FEW), theirs).unionByName(shared(mine.where(F.col("n") <= _FEW), theirs.where(F.col("m") > _FEW)))
    order = F.struct((-F.col("score")).alias("score"), (-F.col("overlap")).alias("overlap"), F.col("record"))
    best = few.unionByName(many).where("overlap >= 0.5").groupBy("title", "c", "who").agg(F.min(order).alias("best"))
    found = a.join(best, ["title", "c", "who"]).groupBy("id").agg(F.min("best").alias("best"))
    return found.select("id", "best.record")


def _left(df: DataFrame, linked: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda d, x: d.join(x.select(key), key, "left_anti"), linked, df)


def _unique(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    def single(df: DataFrame, name: str) -> DataFrame:
        counts = df.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("_n"), F.min_by(F.struct(name, "title"), name).alias("_x"))
        return counts.where("_n = 1").select(key, "_x.*")

    return single(a, "id").join(single(b, "record").withColumnRenamed("title", "r_title"), key)
