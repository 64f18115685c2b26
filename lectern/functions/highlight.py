"""Search text columns: snippets, matched spans, token distances, citation groups and query scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts of Japanese text, and stem endings.
JAPANESE = r"[぀-ヿ一-鿿]"
ENDINGS = "(?:ization|isation|ations?|ings?|ers?|ed|es|s)$"


def highlight_segments(text: Column, terms: list[str]) -> Column:
    """The text cut into (segment, hit) at case-insensitive matches of the terms, in order; nothing is lost."""
    if not terms:
        return F.array(F.struct(text.alias("segment"), F.lit(False).alias("hit")))
    pattern = "|".join(_quoted(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    hits = F.regexp_extract_all(text, F.lit(f"(?i)(?:{pattern})"), F.lit(0))
    rest = F.split(text, f"(?i)(?:{pattern})", -1)
    both = F.flatten(F.transform(rest, lambda r, i: F.array(F.struct(r.alias("segment"), F.lit(False).alias("hit")), F.struct(F.coalesce(F.get(hits, i), F.lit("")).alias("segment"), F.lit(True).alias("hit")))))
    return F.filter(both, lambda s: s["segment"] != "")


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else f"\\{c}" for c in term)


def abstract_view(text: Column, term: str, lead: int = 120) -> Column:
    """(leading, view): if the first match lies past the lead, the view starts at the word before it."""
    at = F.locate(term.lower(), F.lower(text))
    before = F.substring(text, F.lit(1), at - 1)
    word = F.char_length(F.regexp_extract(before, r"(\S+\s+)$", 1))
    return F.when(at > lead, F.struct(F.lit(True).alias("leading"), F.substring(text, at - word, F.char_length(text)).alias("view"))).otherwise(F.struct(F.lit(False).alias("leading"), text.alias("view")))


def is_japanese(query: Column) -> Column:
    """At least half of the characters are kana or kanji."""
    n = F.char_length(F.regexp_replace(query, r"\s+", ""))
    return (n > 0) & (F.regexp_count(query, F.lit(JAPANESE)) * 2 >= n)


def citation_targets(sentence: Column) -> Column:
    """Works cited in a sentence: members of numeric groups, ranges counted in full, and author-year groups."""
    groups = F.regexp_extract_all(sentence, F.lit(r"\[([0-9]+(?:\s*[-–,]\s*[0-9]+)*)\]"), F.lit(1))
    members = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))

    def size(m: Column) -> Column:
        low, high = (F.regexp_extract(m, r"^([0-9]+)(?:\s*[-–]\s*([0-9]+))?$", k).try_cast("int") for k in (1, 2))
        return F.when(high.isNull(), 1).otherwise(F.greatest(high - low + 1, F.lit(1)))

    numeric = F.aggregate(F.transform(members, size), F.lit(0), lambda s, x: s + x)
    named = F.regexp_count(sentence, F.lit(r"[A-Z][a-z]+(?: et al\.)?,? \(?(?:19|20)[0-9]{2}"))
    return numeric + named


def stem(word: Column) -> Column:
    return F.when(F.char_length(word) > 5, F.regexp_replace(word, ENDINGS, "")).otherwise(word)


def stem_contains(text: Column, word: str) -> Column:
    """Whether a word of the text has the stem of the given word."""
    return F.exists(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: stem(w) == stem(F.lit(word.lower())))


def token_distance(tokens: Column, a: str, b: str) -> Column:
    """Fewest positions between two words of a token list; null if one is missing."""
    def places(word: str) -> Column:
        return F.filter(F.transform(tokens, lambda t, i: F.when(t == word, i)), lambda i: i.isNotNull())

    return F.array_min(F.flatten(F.transform(places(a), lambda i: F.transform(places(b), lambda j: F.abs(i - j)))))


def topic_relevant(text: Column, phrase: str, title: Column | None = None, near: int = 3) -> Column:
    """The phrase itself, its two words near each other in the title, or half of its words (two at least)."""
    words, low = phrase.lower().split(), F.lower(text)
    hit = F.contains(low, F.lit(phrase.lower()))
    if title is not None and len(words) == 2:
        tokens = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0))
        hit = hit | F.coalesce(token_distance(tokens, *words) <= near, F.lit(False))
    if len(words) > 2:
        have = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in dict.fromkeys(words)), F.lit(0))
        hit = hit | (have >= max(2, -(-len(words) // 2)))
    return hit


def client_key(address: Column) -> Column:
    """An IPv4 address as it is; of an IPv6 address, written out in full, the first four groups."""
    halves = F.split(F.lower(address), "::", 2)
    def groups(part: Column) -> Column:
        return F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda g: g != "")

    head, tail = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    missing = F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0))
    whole = F.transform(F.concat(head, F.array_repeat(F.lit("0"), missing), tail), lambda g: F.lpad(g, 4, "0"))
    return F.when(F.contains(address, F.lit(":")), F.concat(F.array_join(F.slice(whole, 1, 4), ":"), F.lit("::/64"))).otherwise(address)
