"""The few columns that need Python's Unicode and float tables, as Arrow functions on batches."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

_WORD = re.compile(r"[^0-9a-z]+")


def _fuzzy(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.sub(" ", unicodedata.normalize("NFKC", plain).lower()).strip()


@pandas_udf(StringType())
def fuzzy_title(titles: pd.Series) -> pd.Series:
    """Compatibility forms, no marks, lower case, ASCII words."""
    return titles.map(_fuzzy, na_action="ignore")


@pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@pandas_udf(DoubleType())
def round_exact(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Python's round: half to even on the exact binary value."""
    return pd.Series([None if v != v else round(v, int(d)) for v, d in zip(values, digits, strict=True)], dtype="float64")


def _unmarked(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@pandas_udf(StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Accents and other combining marks off."""
    return texts.map(_unmarked, na_action="ignore")
