"""Which work a citing sentence speaks of: names and markers of the cited work, and a scanner of the clauses around cues.

``identities`` tells the names, first surname and reference marker by which a citing paper's sentences call a cited work;
``sightings`` tells for one sentence whether it points at that work and which kinds of cue govern it. Both are Arrow
functions over columns; rows are independent, and a sentence is read once for all its cues.

The scanner reads a sentence into marks by position: citations (numbered groups, author and year, names of the cited work), own
sections, owners ("proposed by"), and the ends of clauses. A cue governs the first mark of its object, unless an owner is
named or its subject is a third party's work; without a mark the rest of the clause decides.

Defined cases: null texts name nothing; a sentence without any citation speaks of the work only if it names it; names in brackets
that begin with an article describe another work; a name after a hyphen is another's.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lectern.functions import cues

IDENTITY = StructType([StructField("names", ArrayType(StringType())), StructField("surname", StringType()), StructField("marker", IntegerType())])
_TOLD = ("named", "usable", "grouped", "own_variant", "builds", "strongly", "weakly", "contrasts", "while_cites", "usage", "leads")
SIGHTING = StructType([StructField("target", StringType()), StructField("cited", IntegerType()), *(StructField(n, BooleanType()) for n in _TOLD)])

_GENERAL, _NAMES_TOO_GENERAL = frozenset(cues.GENERAL_WORDS), frozenset(cues.GENERAL_NAMES)
_NUMBERED = re.compile(r"\[([^\]]{1,80})\]")
_ITEM = re.compile(r"\s*(\d{1,4})\s*(?:[-–—]\s*(\d{1,4})\s*)?")
_OUR_OWN = regex.compile(r"\bour\s+(?:own\s+)?(?:modified|extended|adapted|customi[sz]ed)\s", regex.I)
_CITED_BY_YEAR = regex.compile(r"(?<!\p{L})(\p{Lu}[\p{L}'’-]+)(?:\s+et\s+al\.?|\s*(?:,|and|&)\s*\p{Lu}[\p{L}'’-]+(?:,?\s*(?:and|&)\s*\p{Lu}[\p{L}'’-]+)?)?,?\s*\(?(?:1[89]|20)\d{2}[a-z]?\b")
_DESCRIBED, _TITLE_WORD_END, _PLURAL = re.compile(r"\((?:a|an)\s[^()]*\)", re.I), regex.compile(r"[^\p{L}\p{N}]+"), regex.compile(r"\p{Lu}[\p{Lu}\p{N}-]+s")
_VERSION = re.compile(r"[-\s]?(v\d+|\d+|\+\+)$")
_SPANNED = re.compile(r"\[(\d{1,4})\]\s*[-–—]\s*\[(\d{1,4})\]")
_YEAR = re.compile(r"\b(?:1[89]|20)\d{2}[a-z]?\b")
_NARRATIVE = re.compile(r"\b[A-Z][\w'-]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][\w'-]+))?\s*\((?:1[89]|20)\d{2}[a-z]?\)")
_BRACKETS = re.compile(r"[\[(]([^\]\[()]{1,160})[\])]")
_ET_AL = regex.compile(r"(?<!\p{L})(\p{Lu}[\p{L}'’-]+)\s+et\s+al\b")
_BIB = regex.compile(r"^\s*(?:\[\d{1,4}\]|\d{1,4}\.)\s+\p{Lu}[\p{L}'’-]*(?:\s+\p{Lu}\.?)*[\s,.]")
_BIB_VENUE = re.compile(r"\b(?:arXiv\s+preprint|In\s+Proceedings|Proc\.|Advances\s+in\s+Neural|pp\.\s*\d|vol\.\s*\d|Conference\s+on)\b", re.I)
_BIB_NAMES = regex.compile(r"^\s*\[\d{1,4}\]\s+(?:\p{Lu}[\p{L}'’.-]*\s+){1,3}\p{Lu}[\p{L}'’-]+,")
_BEFORE_CITATION = regex.compile(r"(?<![\p{L}\p{N}_-])\(?(\p{L}[\p{L}\p{N}-]{1,24})\)?\s*([\[(])")
_METHOD_NAME = regex.compile(r"(?=(?:\P{Lu}*\p{Lu}){2})\p{L}[\p{L}\p{N}-]{1,24}")
_ABBREVIATION = re.compile(r"\b(et\s+al|e\.g|i\.e|cf|vs|Secs?|Fig|Figs|Tab|Eqs?|Eqn|Alg|Thm|App|resp|approx|No)\.", re.I)
_OWN_PART = re.compile(r"(?:\b(?:sections?|secs?|fig(?:ure)?s?|tab(?:le)?s?|eq(?:uation)?s?|eqn|appendi(?:x|ces)|app|alg(?:orithm)?s?|theorems?|thm|lemmas?|propositions?|definitions?)\b|§)\s*[(~]?\s*(?:\d|[A-Z](?:\.\d|\b))", re.I)
_OWNER = re.compile(r"\b(?:proposed|introduced|developed|presented|released|described|suggested|designed|devised|open-?sourced|provided|trained)\s+(?:by|in|from)\s", re.I)
_FIRST = re.compile(r"(?<![\w-])(?:we|our|ours|us)(?![\w-])", re.I)
_ACTIVE = re.compile(r"\b(?:extend(?:s|ed)?|builds?|built|generali[sz]e[sd]?|modif(?:y|ies|ied)|improve[sd]?|adapt(?:s|ed)?|subsume[sd]?)\b", re.I)
_PARTICIPLE = re.compile(r"^(?:built|extended|derived|adapted)\b", re.I)
_GERUND = re.compile(r"^(?:building|extending|built|extended)\b", re.I)
_REACHING = re.compile(r"\b(?:extend\w*|extension|generali[sz]\w*)\b", re.I)
_INSTRUMENT = re.compile(r"\b(?:to|with|using|via)\s", re.I)
_ANAPHOR = re.compile(r"^\s*(?:the\s+former|the\s+latter|this|these|those|that)\b", re.I)
_LISTED = re.compile(r"\b(?:such\s+as|e\.?g\b|including|like|for\s+(?:example|instance)|namely)\b", re.I)
_OWN_THING = re.compile(r"^\s*(?:the\s+)?our\s+(?:own\s+)?(?:[\w-]+\s+){0,2}?(?:models?|methods?|approach(?:es)?|frameworks?|networks?|architectures?|systems?|pipelines?|algorithms?)\b", re.I)
_VARIANT = re.compile(r"^(?:variant|version|adaptation|modification|instantiation|extension)\s+of\b", re.I)
_APPOSED = re.compile(r"([\[(][^\]\[()]{1,160}[\])])\s*,\s*(?:a|an)\s+(?:[\w-]+\s+){0,3}$")
_RELATIVE = re.compile(r"\b(?:which|who|that)\s+(?:also\s+|further\s+)?$", re.I)
_STEP = re.compile(r"[\[(]|[\])]|[;:,]|\.(?=\s|$)|(?<=\S)\s+(?:(?:which|who|whose|where|while|whereas|because|since|but|although|though)\b)?", re.I)
_USED = re.compile(r"\b(?:" + "|".join(cues.USAGE_NOUNS) + r")\b", re.I)
_MODEL, _FINDING = re.compile(cues.RELEASED_MODEL), re.compile(cues.FINDING_NOUNS, re.I)
_OBJECT_END = re.compile(r"[,;:.]|\b(?:who|which|that|where|while|whereas|because|since|but)\b", re.I)
_MOST_WORDS, _MOST_CHARS = 12, 220


def _all(patterns: list[str], flags: int = re.I) -> list[re.Pattern[str]]:
    return [re.compile(p, flags) for p in patterns]


_BUILDS, _STRONG, _WEAK, _CONTRASTS, _INSTANCE = [*_all(cues.ADAPT), *_all(cues.BUILD), *_all(cues.BUILD_CITED, 0)], _all(cues.STRONG_BUILD), _all(cues.WEAK_BUILD), _all(cues.CONTRAST), _all(cues.INSTANCE_OF_OURS)
_WHILE = re.compile(r"^\s*(?:while|whereas)\b[^,;]{0,200},(?=\s*(?:we|our)\b)", re.I)


def folded(text: str) -> str:
    """Without accents, those that stand alone as well, and compatibility forms."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", re.sub("[¨´ˆ-˟]", "", text))
    return unicodedata.normalize("NFC", "".join(c for c in text if not unicodedata.category(c).startswith("M")))


def markers(text: str) -> list[int]:
    """The numbers of all numbered groups, ranges spelled out."""
    out: list[int] = []
    for group in _NUMBERED.finditer(text):
        items = [_ITEM.fullmatch(x) for x in re.split("[,;]", group[1])]
        if all(items):
            for item in items:
                low = int(item[1])
                out.extend(range(low, min(int(item[2]), low + 49) + 1) if item[2] else [low])
    return out


def works_cited(text: str) -> int:
    """How many works a sentence cites; 0 if it has no marker."""
    count = sum(max(1, int(m[2]) - int(m[1]) + 1) for m in _SPANNED.finditer(text))
    rest = _SPANNED.sub(" ", text)
    for group in _NUMBERED.finditer(rest):
        items = [_ITEM.fullmatch(x) for x in re.split("[,;]", group[1])]
        if all(items):
            count += sum(max(1, int(i[2]) - int(i[1]) + 1) if i[2] else 1 for i in items)
    count += len(_NARRATIVE.findall(rest))
    for inner in re.findall(r"\(([^()]{0,400})\)", _NARRATIVE.sub(" ", rest)):
        count += sum(bool(_YEAR.search(part)) for part in inner.split(";"))
    return count


def bibliography_line(text: str) -> bool:
    text = text.strip()
    return bool(_BIB.match(text) and (_BIB_VENUE.search(text) or _YEAR.search(text)) or _BIB_NAMES.match(text))


def usable(text: str) -> bool:
    """Long enough, no entry of a bibliography, and not markers only."""
    text = " ".join(text.split())
    if len(text) < 40 or bibliography_line(text):
        return False
    bare = re.sub(r"\([^()]*\b(?:1[89]|20)\d{2}[a-z]?\b[^()]*\)", " ", re.sub(r"\[[\d,;\s–—-]{1,80}\]", " ", text))
    return sum(c.isalpha() for c in bare) >= 25


def stem(title: str) -> str | None:
    """What stands before a title's colon, if that is five words at most."""
    head, colon, _ = title.partition(":")
    return head.strip() if colon and head.strip() and len(head.split()) <= 5 else None


def _surname(author: str) -> str:
    last, comma, _ = author.partition(",")
    parts = last.split()
    return folded(" ".join(parts) if comma else parts[-1]) if parts else ""


def _title_names(title: str) -> list[str]:
    name = stem(title)
    if name is None or all(w in _GENERAL for w in re.split(r"[\s-]+", name.lower())):
        return []
    out = [name.lower(), re.sub(r"\s+(v?\d)\b", r"\1", name.lower())]
    capitals = [w[0] for w in re.split(r"[\s-]+", name) if w[:1].isupper()]
    if len(capitals) >= 3:
        out.append("".join(capitals).lower())
    words = name.split()
    first = regex.sub(r"[^\p{L}\p{N}-]", "", words[0]).lower()
    if len(words) > 1 and len(first) >= 3 and first not in _GENERAL:
        family = words[1].lower() in cues.STEM_FUNCTION_WORDS
        out += [f"{first}{joint}{noun}" for noun in cues.GROUP_NOUNS for joint in (" ", "-based ")] if family else [first]
    return out


def _author_names(surnames: list[str]) -> list[str]:
    names = [s.lower() for s in surnames]
    if not names or len(names[0]) < 3:
        return []
    out = [f"{names[0]} et al"]
    if len(names) == 2:
        out += [f"{names[0]} and {names[1]}", f"{names[0]} & {names[1]}"]
    elif len(names) == 3:
        out += [f"{names[0]}, {names[1]}{joint}{names[2]}" for joint in (", and ", " and ", ", & ")]
    return out


_LETTER, _LETTER_OR_DIGIT = regex.compile(r"\p{L}"), regex.compile(r"[\p{L}\p{N}]")
#: What letters beyond ASCII equal ASCII ones when case is folded.
_FOLDS_TO_ASCII = re.compile("[\u0130\u0131\u017f\u212a]")


@lru_cache(4096)
def _literal(name: str) -> regex.Pattern[str]:
    return regex.compile(regex.escape(name), regex.I)


def _spots(name: str, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
    """Where a name stands, case folded, from every place. Names differ from row to row, so they are no patterns: to compile one
    takes far longer than to read a sentence. Only what is not ASCII is compared by the pattern's own folding."""
    if not name:
        return
    if name.isascii() and not _FOLDS_TO_ASCII.search(text):
        low, wanted, n = text.lower(), name.lower(), len(name)
        at = low.find(wanted, start)
        while at >= 0:
            yield at, at + n
            at = low.find(wanted, at + 1)
    else:
        for m in _literal(name).finditer(text, start, overlapped=True):
            yield m.span()


def _places(name: str, text: str) -> Iterator[tuple[int, int]]:
    """Places of a folded name that no letter, digit or hyphen precedes and no letter follows."""
    past = 0
    for at, end in _spots(folded(name), text):
        if at >= past and not (at and (text[at - 1] == "-" or _LETTER_OR_DIGIT.match(text, at - 1))) and not _LETTER.match(text, end):
            past = end
            yield at, end


def _surnamed(surname: str, text: str) -> bool:
    return any(not (at and _LETTER.match(text, at - 1)) and not _LETTER.match(text, end) for at, end in _spots(surname, text))


_NUMBER_AFTER = regex.compile(r"(?:[-\s]?[\p{L}\p{N}]{1,6})?\s*\[(\d{1,4})\]")
_YEAR_AFTER = re.compile(r"\.?\s*,?\s*\(?\s*((?:1[89]|20)\d{2})([a-z]?)\b")


def mentions(text: str, name: str) -> bool:
    """Named, and not by authors and years that may be of several works."""
    years, hit = set(), False
    for _, end in _places(name, text):
        hit, year = True, _YEAR_AFTER.match(text, end)
        if year and year[2]:
            return False
        if year:
            years.add(year[1])
    return hit and len(years) <= 1


def _marker(contexts: list[str], names: list[str], surname: str | None, title: str) -> int | None:
    """Of a bibliography's line, else by votes of what stands after a name and of sole citations, else what all share."""
    words = [w for w in _TITLE_WORD_END.split(title.lower()) if len(w) >= 4 and w not in _GENERAL]
    votes: Counter[int] = Counter()
    shared, seen = None, 0
    for context in contexts:
        text = folded(context)
        own = markers(context)
        if bibliography_line(context):
            number = re.match(r"\s*\[(\d{1,4})\]", context)
            low = text.lower()
            if number and (surname and surname in low or words and 2 * sum(w in low for w in words) >= len(words)):
                return int(number[1])
        elif own:
            seen += 1
            shared = set(own) if shared is None else shared & set(own)
        for name in names:
            past = 0
            for at, end in _spots(folded(name), text):
                if at >= past and not (at and _LETTER_OR_DIGIT.match(text, at - 1)) and (m := _NUMBER_AFTER.match(text, end)):
                    past = m.end()
                    votes[int(m[1])] += 3
        if len(own) == 1 and works_cited(context) == 1:
            votes[own[0]] += 1
    if votes:
        most = max(votes.values())
        return next(n for n, v in votes.items() if v == most)
    return next(iter(shared)) if shared and seen >= 2 and len(shared) == 1 else None


def _given_names(contexts: list[str], surname: str | None, marker: int | None) -> list[str]:
    """Names of methods that sentences write right before the work's own citation."""
    out = []
    for context in map(folded, contexts):
        for m in _BEFORE_CITATION.finditer(context):
            name = m[1][:-1] if _PLURAL.fullmatch(m[1]) else m[1]
            low = name.lower()
            if not _METHOD_NAME.fullmatch(name) or len(low) < 3 or low in _GENERAL or low in _NAMES_TOO_GENERAL:
                continue
            rest = context[m.end() : m.end() + 120]
            if m[2] == "[":
                mine = marker is not None and marker in markers("[" + rest[: rest.find("]") + 1])
            else:
                after = rest.lower()[len(surname or "") :]
                mine = bool(surname) and rest.lower().startswith(surname) and bool(re.match(r"[\s,&]|\s*et\s+al|\s+and\b", after))
                mine = mine and not re.search(r"\b(?:1[89]|20)\d{2}[a-z]\b", rest[: rest.find(")")] if ")" in rest else rest[:60])
            if mine and low not in out:
                out.append(low)
    return out


def identity(title: str | None, authors: list[str] | None, contexts: list[str] | None) -> tuple[list[str], str | None, int | None]:
    sentences = [c for c in contexts or [] if c]
    surnames = [s for s in map(_surname, (a for a in authors or [] if a)) if s]
    names = [n for n in dict.fromkeys([*_title_names(title or ""), *_author_names(surnames)]) if len(n) >= 3]
    surname = surnames[0].lower() if surnames and len(surnames[0]) >= 3 else None
    marker = _marker(sentences, names, surname, title or "")
    return names + [n for n in _given_names(sentences, surname, marker) if n not in names], surname, marker


class Sentence:
    """A sentence read for one cited work."""

    def __init__(self, text: str, names: list[str], surname: str | None, marker: int | None) -> None:
        self.raw = " ".join(text.split())
        same = folded(self.raw)
        self.text = same if len(same) == len(self.raw) else self.raw
        self.names, self.surname, self.marker = names, surname, marker
        self.count, self.numbers = works_cited(self.raw), markers(self.raw)
        families = [(n, _VERSION.sub("", n)) for n in names]
        self.families = [f for n, f in families if len(f) >= 4 and f != n]
        self.named = any(mentions(self.text, n) for n in names)
        self.masked = _ABBREVIATION.sub(lambda m: m[0][:-1] + " ", self.text)
        self.bare = _DESCRIBED.sub(lambda m: " " * len(m[0]), self.text)
        marks = self._citations()
        every = [(at, True) for n in names if not n.endswith(" et al") for at, _ in _places(n, self.bare)]
        self.cited_at, self.marked_at = sorted(marks), sorted([*marks, *every])
        self._spans: dict[re.Pattern[str], list[tuple[int, int]]] = {}

    def _found(self, pattern: re.Pattern[str]) -> list[tuple[int, int]]:
        """Spans of a cue; several questions ask for the same cues."""
        if pattern not in self._spans:
            self._spans[pattern] = [m.span() for m in pattern.finditer(self.raw)]
        return self._spans[pattern]

    def _citations(self) -> list[tuple[int, bool | None]]:
        """Places of citations, each with whether it is the work's (None: can't be told)."""
        who = self.surname
        alone = True if self.count == 1 else None
        out: list[tuple[int, bool | None]] = []
        for m in _BRACKETS.finditer(self.text):
            numbers = markers(f"[{m[1]}]")
            if numbers:
                out.append((m.start(), self.marker in numbers if self.marker is not None else alone))
            elif _YEAR.search(m[1]) and regex.search(r"\p{Lu}[\p{L}'’-]+", m[1]):
                out.append((m.start(), _surnamed(who, m[1]) if who else alone))
        return out + [(m.start(), _surnamed(who, m[1]) if who else None) for m in _ET_AL.finditer(self.text)]

    def _within(self, marks: list[tuple[int, bool | None]], start: int, end: int) -> list[tuple[int, bool | None]]:
        return marks[bisect_left(marks, (start,)) : bisect_left(marks, (end,))]

    def names_family(self, start: int = 0, end: int | None = None, masked: bool = False) -> bool:
        span = (self.bare if masked else self.text)[start:end]
        return any(mentions(span, f) for f in self.families)

    def target(self) -> str:
        if self.named or self.marker is not None and self.marker in self.numbers:
            return "named"
        if self.marker is not None and self.numbers and self.count == len(self.numbers):
            return "other"
        if self.count == 1 and self.surname and not self.numbers:
            years = _CITED_BY_YEAR.findall(self.text)
            if years and self.surname not in (y.lower() for y in years):
                return "other"
        return {0: "unmarked", 1: "single", 2: "pair"}.get(self.count, "multi")

    def grouped(self) -> bool:
        """Told by a marker only that always stands among others."""
        if self.marker is None or self.named or self.names_family():
            return False
        groups = [g for g in (markers(m[0]) for m in _NUMBERED.finditer(self.raw)) if self.marker in g]
        return bool(groups) and all(len(g) > 1 for g in groups)

    def _object(self, start: int) -> tuple[int, bool]:
        """Where the object of a cue ends, and whether its length alone ends it."""
        end, depth, words = min(len(self.masked), start + _MOST_CHARS), 0, 0
        for m in _STEP.finditer(self.masked, start, end):
            sign = m[0].strip()
            if sign in ("(", "["):
                depth += 1
            elif sign in (")", "]"):
                depth = max(0, depth - 1)
            elif depth:
                continue
            elif sign:
                return m.start(), False
            elif m.start() > start:
                words += 1
                if words >= _MOST_WORDS:
                    return m.start(), True
        return end, end < len(self.masked)

    def governed(self, start: int, end: int) -> str:
        """What the cue at a place governs: cited, other, self, distant (nothing near) or none (the clause decides)."""
        cue = self.text[start:end]
        if any(mine for _, mine in self._within(self.marked_at, start, end)):
            return "cited"
        head = self.masked[:start]
        clause = max(head.rfind(". "), head.rfind(";"), head.rfind(":")) + 1
        subject, before = head[clause:], self._within(self.cited_at, clause, start)
        third = before and not _FIRST.search(subject)
        if _ACTIVE.search(cue) and not _GERUND.match(cue.strip()):
            if third and not _FIRST.search(cue):
                return "other"
            if _RELATIVE.search(head):
                own = [m.start() for m in _FIRST.finditer(head)]
                told = self._within(self.cited_at, max(own[-1] if own else clause, clause), start)
                if told and all(mine is False for _, mine in told):
                    return "other"
        if _PARTICIPLE.match(cue.strip()) and third and all(mine is False for _, mine in before):
            return "other"
        if _VARIANT.match(cue):
            apposed = _APPOSED.search(self.text[:start])
            told = self._within(self.marked_at, apposed.start(1), apposed.end(1)) if apposed else []
            if told and all(mine is False for _, mine in told):
                return "other"
        stop, capped = self._object(end)
        thing = self.text[end:stop]
        if _VARIANT.match(cue) and _OWN_THING.match(thing):
            return "self"
        marks = self._within(self.marked_at, end, stop)
        for m in _OWNER.finditer(self.masked, end, stop):
            owner = next((mine for at, mine in marks if m.end() - 1 <= at <= m.end() + 60), None)
            if owner is not None:
                return "cited" if owner else "other"
        events = [(at, "cited" if mine else "other", False) for at, mine in marks if mine is not None]
        if part := _OWN_PART.search(self.masked, end, stop):
            events.append((part.start(), "self", False))
        if not marks and _ANAPHOR.match(thing):
            events.append((end, "self", False))
        if _REACHING.search(cue):
            for m in _INSTRUMENT.finditer(self.text, end, stop):
                events.append((m.start(), "other", True))
        if not events:
            return "distant" if capped else "none"
        at, kind, reached = min(events)
        listed = _LISTED.search(self.text, end, stop)
        return "none" if listed and listed.start() <= at and kind == "other" and not reached else kind

    def governs(self, patterns: list[re.Pattern[str]], exempt: list[re.Pattern[str]] = (), ends: str = ".;") -> bool:
        """Whether a cue of these patterns is about the work."""
        if any(self._found(p) for p in exempt):
            return True
        worded = self.named or self.names_family()
        for pattern in patterns:
            for start, end in self._found(pattern):
                found = self.governed(start, end)
                if found == "cited":
                    return True
                if found == "none" and self._clause(start, worded, ends):
                    return True
        return False

    def _clause(self, start: int, worded: bool, ends: str) -> bool:
        stop = re.search(rf"[{re.escape(ends)}](?:\s|$)", self.raw[start:])
        end = min(start + (stop.start() if stop else len(self.raw)), start + 300)
        if any(mentions(self.bare[start:end], n) for n in self.names) or self.names_family(start, end, masked=True):
            return True
        span = self.raw[start:end]
        if self.marker is None:
            return not worded and self.count <= 1 and works_cited(span) >= 1
        if worded or self.count <= 1:
            return self.marker in markers(span)
        first = _NUMBERED.search(span)
        return bool(first) and self.marker in markers(first[0])

    def own_variant(self) -> bool:
        return bool(_OUR_OWN.search(self.text)) and any(regex.search(rf"\bour\s+(?:own\s+)?(?:modified|extended|adapted|customi[sz]ed)\s+(?:version\s+of\s+(?:the\s+)?)?{regex.escape(folded(n))}(?!\p{{L}})", self.text, regex.I) for n in self.names)

    def while_cites(self) -> bool:
        m = _WHILE.match(self.raw)
        if not m:
            return False
        clause = self.text[: m.end()]
        if any(mentions(clause, n) for n in self.names) or self.names_family(0, m.end()):
            return True
        return self.marker in markers(clause) if self.marker is not None else self.count == 1 and works_cited(clause) >= 1

    def usage(self) -> bool:
        """Every strong cue's object (or passive subject) is a thing in use: a resource, a released model, a finding."""
        found = [span for p in _STRONG for span in self._found(p)]
        kinds = []
        for start, end in found:
            tail = self.raw[end : end + 90]
            stop = _OBJECT_END.search(tail)
            thing = " ".join((tail[: stop.start()] if stop else tail).split()[:9])
            head = re.sub(r"\b(?:is|are|was|were|been|be)\s*$", "", re.split(r"[,;:.(]", self.raw[max(0, start - 90) : start])[-1])
            subject = " ".join(head.split()[-4:])
            resource = bool(_USED.search(thing)) or not re.search(r"^we\b|\bwe$", subject, re.I) and bool(_USED.search(subject))
            kinds.append((resource, bool(_MODEL.search(thing)), bool(_FINDING.search(thing))))
        return bool(kinds) and any(all(k[0] or k[n] for k in kinds) for n in (0, 1, 2))


def sighting(text: str | None, names: list[str] | None, surname: str | None, marker: int | None, abstract: bool) -> tuple:
    if not text:
        return ("unmarked", 0, *[False] * len(_TOLD))
    s, ends = Sentence(text, list(names if names is not None else []), surname, None if marker is None or marker != marker else int(marker)), ".;," if abstract else ".;"
    builds = s.governs(_BUILDS, _INSTANCE, ends)
    return (s.target(), s.count, s.named, usable(text), s.grouped(), s.own_variant(), builds, builds and s.governs(_STRONG, _INSTANCE, ends), s.governs([*_WEAK, *_BUILDS], (), ends), s.governs(_CONTRASTS, (), ends), s.while_cites(), s.usage(), any(mentions(s.text[:30], n) for n in s.names))


@pandas_udf(IDENTITY)
def identities(titles: pd.Series, authors: pd.Series, contexts: pd.Series) -> pd.DataFrame:
    """(names, surname, marker) by which the contexts call a work of a title and authors."""
    return pd.DataFrame([identity(t, None if a is None else list(a), None if c is None else list(c)) for t, a, c in zip(titles, authors, contexts, strict=True)], columns=["names", "surname", "marker"]).astype({"marker": "Int32"})


@pandas_udf(SIGHTING)
def sightings(texts: pd.Series, names: pd.Series, surnames: pd.Series, numbers: pd.Series, abstracts: pd.Series) -> pd.DataFrame:
    """What a sentence says of the work that goes by these names and marker; of an abstract's, by its name and phrase."""
    rows = [sighting(*row) for row in zip(texts, names, surnames, numbers, abstracts, strict=True)]
    return pd.DataFrame(rows, columns=SIGHTING.names)
