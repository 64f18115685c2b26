"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are lower-cased, compatibility forms and homoglyphs are folded to the letters they imitate, and digits and signs
next to letters to the letters they stand for (a number stays one). Accents, soft hyphens and characters without width
go, letters set apart by dots or blanks are joined, and words are then set apart by single spaces. Lexicon entries are
whole words, word beginnings and pairs of words. A word counts once, with its heaviest entry; hits inside an exception
phrase do not count. The sum is taken as it is and normalised by length, and a logistic curve makes a score of both.

Weights are log ratios of an entry's frequency in toxic and other labelled texts. Of toxic texts no more count than
the entry has distinct contexts (the word with its neighbours) in them, so that copies of one text do not make its
words entries. Only labelled rows are bounded in number: every entry that is frequent enough in them and heavy enough
is taken, unless ``max_entries`` is given.

Defined cases: null and empty texts score as texts without hits; without labels of both kinds the seed words and
default coefficients hold; a document with several labels counts as toxic if one says so; further columns are ignored; repeated rows give one row each.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import sliced, texts
from lectern.llm.labelled import logistic, sigmoid, training_texts
from lectern.plans.storage import discard, materialize

# Letters of other scripts and digits that imitate Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n", "ɡ": "g", "ı": "i", "ɑ": "a", "ո": "n", "ս": "u", "օ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SEED_WORDS = ("idiot", "moron", "scum", "stupid", "loser", "pathetic", "worthless", "disgusting")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "sore loser", "stupid simple", "worthless check")
SEED_WEIGHT = 6.0
DEFAULT_COEFFICIENTS = (2.0, 0.5, -3.0)

_FOLD, _SUBSTITUTES = str.maketrans(HOMOGLYPHS), str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")  # accents, and characters without width
_SUBSTITUTED = re.compile(r"(?<=[^\W\d_])[\d@$]+(?=[^\W\d_])|(?<=[^\W\d_])\d+|\d+(?=[^\W\d_])|(?<![\w@$])[@$](?=[^\W\d_])")
_APART = re.compile(r"(?<!\w)[a-z](?:[.*_-][a-z]){2,}(?!\w)|(?<!\w)[a-z](?: [a-z]){3,}(?!\w)")
_LETTER = re.compile("[a-z]")
_BEGINNINGS = (4, 5, 6)


def folded_words(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).translate(_FOLD)
    text = _SUBSTITUTED.sub(lambda m: m[0].translate(_SUBSTITUTES), text)
    return _WORD.findall(_APART.sub(lambda m: "".join(_LETTER.findall(m[0])), text))


def entries_of(word: str) -> list[str]:
    """The whole word and its beginnings, each with the space before it."""
    return [f" {word} ", *(f" {word[:k]}" for k in _BEGINNINGS if len(word) > k)]


class Lexicon:
    """Weighted entries, exception phrases and the coefficients of (log sum, log sum per 100 words, 1)."""

    def __init__(self, weights: dict[str, float], coefficients: tuple[float, ...] = DEFAULT_COEFFICIENTS, exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        self.weights, self.coefficients, self.exceptions = weights, coefficients, exceptions
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _built(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(entry := f" {phrase} ", (len(entry), -1.0))
            self._automaton.make_automaton()
        return self._automaton

    def features(self, text: str) -> tuple[float, float]:
        words = folded_words(text)
        if not words or not (self.weights or self.exceptions):
            return 0.0, 0.0
        heaviest: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self._built().iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight < 0:
                spared.append((start, end))
            elif weight > heaviest.get(start, 0.0):
                heaviest[start] = weight
        for a, b in spared:
            for at in [at for at in heaviest if a <= at < b]:
                del heaviest[at]
        total = math.fsum(heaviest.values())
        return math.log1p(total), math.log1p(100 * total / (len(words) + 50))

    def scores(self, batch: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in batch], dtype=np.float64).reshape(-1, 2)
        *w, b = self.coefficients
        return sigmoid(x @ np.array(w) + b)


def _contexts(sample: DataFrame) -> DataFrame:
    """(entry, contexts) over toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = set()
            for cell in batch.column(0):
                w = ["", *folded_words(cell.as_py()), ""]
                for k in range(1, len(w) - 1):
                    context = zlib.crc32(" ".join(w[k - 1 : k + 2]).encode("utf-8", "replace"))
                    rows.update((e, context) for e in entries_of(w[k]))
                    rows.add((f" {w[k]} {w[k + 1]} ", context))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["entry", "context"])

    found = sample.select("text").mapInArrow(run, "entry string, context long")
    return found.distinct().groupBy("entry").agg(F.count("*").alias("n"))


def _frequencies(sample: DataFrame, entries: list[str]) -> DataFrame:
    """(entry, n): texts with each of the entries."""
    held = sample.sparkSession.sparkContext.broadcast(frozenset(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = Counter()
            for cell in batch.column(0):
                words = folded_words(cell.as_py())
                pairs = {f" {a} {b} " for a, b in zip(words, words[1:], strict=False)}
                n.update((pairs | {e for w in set(words) for e in entries_of(w)}) & held.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["entry", "n"])

    return sample.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 6000, max_entries: int | None = None, least_weight: float = 2.5) -> Lexicon:
    """A lexicon from at most ``per_class`` toxic and as many other training texts."""
    sample = materialize(training_texts(docs, labels, label, per_class), "toxic-sample")
    counts = dict(sample.groupBy("label").count().collect())
    seed = {f" {w} ": SEED_WEIGHT for w in SEED_WORDS}
    if not (counts.get(0) and counts.get(1)):
        return Lexicon(seed)
    toxic, other = (sample.where(F.col("label") == k) for k in (1, 0))
    least = 3 + 0.002 * counts[1]
    frequent = _contexts(toxic).where(F.col("n") >= least).orderBy(F.desc("n"), "entry")
    seen = (frequent.limit(max_entries) if max_entries else frequent).collect()
    entries = [r["entry"] for r in seen]
    hits, common = (dict(_frequencies(part, entries).collect()) for part in (toxic, other))
    found = {r["entry"]: min(r["n"], hits.get(r["entry"], 0)) for r in seen}
    weights = {e: math.log((n + 0.5) / counts[1] * counts[0] / (common.get(e, 0) + 0.5)) for e, n in found.items() if n >= least}
    lexicon = Lexicon(seed | {e: w for e, w in weights.items() if w >= least_weight})
    held = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = np.array([held.value.features(c.as_py()) for c in batch.column(0)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], names=["a", "b", "label"])

    points = np.array([tuple(r) for r in sample.mapInArrow(run, "a double, b double, label int").collect()], dtype=np.float64)
    lexicon.coefficients = tuple(logistic(points[:, :2], points[:, 2]))
    discard(sample)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score)."""
    src = texts(docs, id_col, text_col)
    held = src.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores([c.as_py() for c in batch.column(1)]))], names=["id", "score"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, lexicon: Lexicon, below: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that score below the limit."""
    held, at = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(held.value.scores([c.as_py() or "" for c in batch.column(at)]) < below))

    return docs.mapInArrow(run, docs.schema)
