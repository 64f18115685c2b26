"""Text columns: titles, previews, keys, guards and parsers. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMULA = r"^[=+\-@\t\r]"
STOP = ["a", "an", "the", "of", "on", "in", "for", "and", "to", "with", "via"]


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def content_words(text: Column) -> Column:
    return F.filter(tokens(text), lambda w: ~w.isin(STOP))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def compact_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def title_score(a: Column, b: Column) -> Column:
    """1 for equal titles or keys, else the similarity of their word sets."""
    return F.when((a == b) | ((compact_key(a) == compact_key(b)) & (compact_key(a) != "")), 1.0).otherwise(jaccard(tokens(a), tokens(b)))


def titles_diverge(a: Column, b: Column, below: float = 0.5, least: int = 3) -> Column:
    x, y = content_words(a), content_words(b)
    return (F.size(x) >= least) & (F.size(y) >= least) & (jaccard(x, y) < below)


def author_overlap(a: Column, b: Column) -> Column:
    """Shared surnames of two lists of names, by the smaller list."""
    def surnames(x: Column) -> Column:
        return F.array_distinct(F.transform(x, surname))

    least = F.least(F.size(surnames(a)), F.size(surnames(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(surnames(a), surnames(b))) / least)


def surname(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def abstract_preview(text: Column, most: int = 320) -> Column:
    """At most so many characters, cut at the last blank, with an ellipsis."""
    cut = F.substring(text, 1, most)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+\S*\z", ""), F.lit("…")))


def formula_guard(cell: Column) -> Column:
    return F.when(F.regexp(cell, F.lit(FORMULA)), F.concat(F.lit("'"), cell)).otherwise(cell)


def formula_unguard(cell: Column) -> Column:
    return F.regexp_replace(cell, r"^'(?=[=+\-@\t\r])", "")


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, "​‌‍﻿", "")


def lenient_int(text: Column) -> Column:
    """The integer part of number-like text, else null."""
    plain = F.regexp_extract(F.trim(text), r"^([+-]?[0-9]{1,18})(?:\.[0-9]*)?$", 1)
    return F.when(plain != "", plain.try_cast("long"))


def term_variants(term: Column) -> Column:
    """The term and, from five letters on, its plural stems."""
    return F.array_compact(F.array(term, F.when((F.char_length(term) >= 5) & F.endswith(term, F.lit("s")), F.regexp_replace(term, "s$", "")), F.when((F.char_length(term) >= 5) & F.endswith(term, F.lit("es")), F.regexp_replace(term, "es$", ""))))


def title_sort_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"^[^0-9A-Za-z]+", ""))


def slug(text: Column, most: int = 64) -> Column:
    """ASCII words joined by hyphens."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")


def bibtex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def bibtex_key(name: Column, year: Column, title: Column) -> Column:
    """Surname, year and the title's first content word."""
    return F.concat(F.regexp_replace(surname(name), "[^a-z0-9]", ""), year.cast("string"), F.coalesce(F.get(content_words(title), F.lit(0)), F.lit("untitled")))


def uniquifier(nth: Column) -> Column:
    """Suffix of the nth entry (from 1) of a key: none, a to z, then the number."""
    return F.when(nth == 1, "").when(nth <= 27, F.char((96 + nth - 1).cast("int"))).otherwise(nth.cast("string"))


def strip_tags(html: Column) -> Column:
    return collapse(F.regexp_replace(html, "<[^>]+>", " "))


def year_bucket(year: Column, low: int = 1900, high: int = 2100) -> Column:
    return F.when(year.between(low, high), year.cast("string")).otherwise("unknown")


def age_text(days: Column) -> Column:
    return (
        F.when(days <= 0, "today").when(days < 30, F.concat(days.cast("string"), F.lit("d")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo"))).otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y")))
    )


def author_credit(names: Column) -> Column:
    n = F.size(names)
    first, second = surname(F.get(names, F.lit(0))), surname(F.get(names, F.lit(1)))
    return F.when(n == 0, "").when(n == 1, first).when(n == 2, F.concat(first, F.lit(" and "), second)).otherwise(F.concat(first, F.lit(" et al.")))


def duration_ms(text: Column) -> Column:
    """1m30s-like text in milliseconds; null if it is nothing of the kind."""
    def part(unit: str) -> Column:
        return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"([0-9]+){unit}(?![a-z])", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))

    return F.when(F.regexp(text, F.lit(r"^([0-9]+h)?([0-9]+m)?([0-9]+s)?([0-9]+ms)?$")) & (text != ""), part("h") * 3_600_000 + part("m") * 60_000 + part("s") * 1000 + part("ms"))


def decode_inverted_index(index: Column) -> Column:
    """Words of a map from word to positions, in order of position."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def single_word_typo(a: Column, b: Column, most: int = 2) -> Column:
    """Same number of words, four at least, one differs, by at most ``most`` edits, both of seven letters at least."""
    x, y = F.split(a, " "), F.split(b, " ")
    differing = F.filter(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"), (p != q).alias("d"))), lambda z: z["d"])
    one = F.get(differing, F.lit(0))
    return (F.size(x) == F.size(y)) & (F.size(x) >= 4) & (F.size(differing) == 1) & (F.char_length(one["p"]) >= 7) & (F.char_length(one["q"]) >= 7) & (F.levenshtein(one["p"], one["q"]) <= most)
