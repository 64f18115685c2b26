"""Ordered rule cascades as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_boundaries(pattern: str) -> str:
    r"""A pattern whose \b, at the start or end of an ASCII word, minds ASCII words only: the JVM's own takes accented
    letters as word characters."""
    pattern = re.sub(r"\\b(?=$|[)|])", "(?![0-9A-Za-z_])", pattern)
    return pattern.replace(r"\b", "(?<![0-9A-Za-z_])")


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.regexp(text, F.lit(ascii_boundaries(p))) for p in patterns))


def matched_tags(low: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Tags of all rules that match a lower-cased text, in rule order. Give it a column, not an expression: it is read
    once for each pattern."""
    return F.array_compact(F.array(*(F.when(any_of(low, patterns), F.lit(tag)) for tag, patterns in rules)))


def or_default(found: Column, default: str = "Other") -> Column:
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def first_rule(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), value)
    return out.otherwise(F.lit(default))


def quality_tier(template_ratio: Column) -> Column:
    return F.when(template_ratio < 0.3, "good").when(template_ratio < 0.7, "mixed").otherwise("poor")
