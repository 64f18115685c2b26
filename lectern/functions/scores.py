"""Score columns of the collection pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, runs of - _ / as one blank."""
    return F.regexp_replace(F.lower(text), "[-_/]+", " ")


def matched_keywords(text: Column, keywords: list[str]) -> Column:
    """The keywords contained in the text, sorted."""
    found = normalized(text)
    return F.array_sort(F.array_compact(F.array(*(F.when(F.contains(found, F.lit(k)), F.lit(k)) for k in dict.fromkeys(keywords)))))


def keyword_score(matched: Column, full: int = 3) -> Column:
    return F.least(F.size(matched) / F.lit(float(full)), F.lit(1.0)) * 100


def saturated(value: Column, full: float) -> Column:
    return F.least(value.cast("double") / F.lit(full), F.lit(1.0)) * 100


def stars_score(stars: Column, most: int = 10_000) -> Column:
    return F.ln(F.least(stars, F.lit(most)) + 1.0) / F.ln(F.lit(most + 1.0)) * 100


def velocity_score(citations: Column, published: Column, today: Column, full: float = 2.0) -> Column:
    """Citations a day since publication; a future date counts as today, the first day as one."""
    days = F.greatest(F.datediff(today, F.least(published, today)), F.lit(1))
    return F.least(citations / days / F.lit(full), F.lit(1.0)) * 100


def seed_score(citations: Column, age: Column, survey: Column) -> Column:
    return (citations + 1) / F.greatest(age, F.lit(0.5)) * F.when(survey, 0.3).otherwise(1.0)


def is_trending(citations: Column, age: Column, rate: float = 200.0, max_age: float = 3.0) -> Column:
    return (age <= max_age) & (citations / F.greatest(age, F.lit(0.5)) >= rate)


def citation_heat(citations: Column) -> Column:
    return F.least(F.log10(citations + 1.0) / F.log10(F.lit(500_001.0)), F.lit(1.0))


def heat_bucket(heat: Column, buckets: int = 6) -> Column:
    return F.least(F.floor(heat * buckets), F.lit(buckets - 1)).cast("int")


def venue_tier(venue: Column, tiers: list[list[str]]) -> Column:
    """1 for the first list's venues and so on, 0 for others."""
    out, name = F.lit(0), F.upper(F.trim(venue))
    for k in range(len(tiers), 0, -1):
        out = F.when(name.isin([t.upper() for t in tiers[k - 1]]), k).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similarity_score(cos: Column) -> Column:
    return F.greatest(F.least((cos + 1) / 2 * 100, F.lit(100.0)), F.lit(0.0))
