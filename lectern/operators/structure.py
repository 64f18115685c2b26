"""Structural difference of nested JSON documents, level by level.

Pairs of documents are walked from the top down, opened as VARIANT values: each round opens the objects and arrays that both sides have
at a pointer, matches their members by name or place in a full outer join, and keeps what differs; it ends when nothing is left to
open. Every round is keyed by (document, pointer), so a document of any size spreads over many tasks.

Kinds: type_mismatch (its members are not compared), length_mismatch (of arrays, whose members are compared as well),
missing_in_expected, missing_in_actual, value_mismatch. Order of an object's members doesn't count, an array's does; numbers are
equal by value.

Defined cases: a null document is JSON null; text that is no JSON is an error that names no row; a pointer in ``ignore``, whose ``*``
stands for any one segment, is skipped with all below it; documents whose keys repeat are pairs of their own only if their
keys differ, so keys must be unique; nesting deeper than ``most`` is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.storage import materialize

_KIND = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _type(v: Column) -> Column:
    """object, array, string, boolean, null or number; null where a side has nothing."""
    head = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(v.isNotNull(), F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in _KIND.items() for x in pair)), head), F.lit("number")))


def _ignored(pointer: Column, ignore: list[str]) -> Column:
    if not ignore:
        return F.lit(False)
    wanted = "|".join("/".join("[^/]*" if part == "*" else re.escape(part) for part in p.split("/")) for p in ignore)
    return F.regexp(pointer, F.lit(f"^(?:{wanted})(?:/|$)"))


def _members(rows: DataFrame, side: str) -> DataFrame:
    """(doc, at, member, value) of the objects and arrays of one side."""
    opened = rows.select("doc", F.col("pointer").alias("at"), F.parse_json(side).alias("v"))
    out = opened.lateralJoin(opened.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return out.select("doc", "at", F.coalesce(F.col("key"), F.col("pos").cast("string")).alias("member"), F.to_json("value").alias(side))


def json_diff(rows: DataFrame, key: str, expected: str, actual: str, ignore: list[str] | None = None, most: int = 64) -> DataFrame:
    """(doc, pointer, kind, expected, actual) of documents given as JSON text; both values as JSON text, or null where missing."""
    ignore = ignore or []
    frontier = rows.select(F.col(key).alias("doc"), F.lit("").alias("pointer"), *(F.coalesce(F.col(c), F.lit("null")).alias(side) for c, side in ((expected, "e"), (actual, "a"))))
    found = None
    for _ in range(most):
        level = materialize(frontier.withColumns({"et": _type(F.parse_json("e")), "at": _type(F.parse_json("a"))}), "diff-level")
        numbers = [F.try_variant_get(F.parse_json(side), "$", "double") for side in ("e", "a")]
        sizes = [F.size(F.variant_get(F.parse_json(side), "$", "array<variant>")) for side in ("e", "a")]
        plain = [F.to_json(F.parse_json(side)) for side in ("e", "a")]
        kind = (
            F.when(F.col("et").isNull(), "missing_in_expected").when(F.col("at").isNull(), "missing_in_actual").when(F.col("et") != F.col("at"), "type_mismatch")
            .when(F.col("et") == "array", F.when(sizes[0] != sizes[1], "length_mismatch"))
            .when(F.col("et") != "object", F.when(F.when(F.col("et") == "number", numbers[0] != numbers[1]).otherwise(plain[0] != plain[1]), "value_mismatch"))
        )
        told = level.withColumn("kind", kind).where("kind is not null")

        told = told.select("doc", "pointer", "kind", *(F.when(F.col("kind") == "length_mismatch", n.cast("string")).otherwise(F.col(side)).alias(name) for n, side, name in zip(sizes, ("e", "a"), ("expected", "actual"), strict=True)))
        found = told if found is None else found.unionByName(told)
        inner = level.where("et = at and et in ('object', 'array')")
        if inner.isEmpty():
            return found
        both = _members(inner, "e").join(_members(inner, "a"), ["doc", "at", "member"], "full_outer")
        segment = F.replace(F.replace("member", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        below = both.select("doc", F.concat("at", F.lit("/"), segment).alias("pointer"), "e", "a")
        frontier = below.where(~_ignored(F.col("pointer"), ignore))
    raise RuntimeError(f"documents are nested deeper than {most}")
