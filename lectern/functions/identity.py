"""Identity columns: stable ids, URL parts and the years that identifiers carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(source: Column, source_id: Column) -> Column:
    """40 hexadecimal digits of a versioned hash."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit("lectern:v1"), source, source_id).cast("binary"), 256), 1, 40)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^https?://([^/?#]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://[^/?#]+/([^?#]*)", 1)


def doi(text: Column) -> Column:
    """The bare lower-case DOI of a URL or prefixed form; empty if there is none."""
    return F.lower(F.regexp_extract(F.trim(text), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.[0-9]{4,9}/\S+)$", 1))


def preprint_id(text: Column) -> Column:
    """The modern preprint number of a URL, DOI or bare form, without its version; empty if there is none."""
    return F.regexp_extract(F.trim(text), r"(?i)^(?:https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf)/|arxiv:|10\.48550/arxiv\.)?([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:\.pdf)?$", 1)


def work_id(text: Column) -> Column:
    return F.regexp_extract(text, r"(?:^|/)(W[0-9]+)$", 1)


def uid(preprint: Column, doi_: Column, url: Column) -> Column:
    """The first identifier known, by precedence."""
    def tagged(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}:"), F.lower(value)))

    return F.coalesce(tagged("arxiv", preprint), tagged("doi", doi_), tagged("url", url))


def id_year(code: Column, pivot: int = 91) -> Column:
    """The year of a YYMM number, if its month is one."""
    yy, month = (F.regexp_extract(code, r"^([0-9]{2})([0-9]{2})\.", k).try_cast("int") for k in (1, 2))
    return F.when(month.between(1, 12), F.when(yy >= pivot, 1900 + yy).otherwise(2000 + yy))


def trustworthy_year(published: Column, created: Column, gap: int = 3) -> Column:
    return F.when(published - created >= gap, created)
