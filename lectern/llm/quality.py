"""Quality classifier: linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators of a text: its lower-cased words and marks, and the 2-grams and 3-grams of the sequence of their shapes
(lower, capital or upper case, number, repetition of the word before, or the mark itself). Each known indicator is
scaled by the log ratio of its smoothed relative counts in the two classes, the vector is brought to length one, and
a support vector machine is fitted to it by dual coordinate descent. A logistic curve, fitted to a fifth of the
sample that the machine did not see, makes a score of the margin.

Only labelled rows are bounded in number: every indicator that ``least`` of them hold counts, unless
``max_indicators`` is given.

Defined cases: null and empty texts have no indicators and score by the constant; without training rows of both
classes nothing is known, so every text scores 0.5 and ``keep`` keeps all; a document with several labels counts as
good if one says so; further columns are ignored; repeated rows give one row each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import sliced, texts
from lectern.llm.labelled import logistic, sigmoid, training_texts
from lectern.plans.storage import discard, materialize

_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")


class _Shapes(dict):
    """Shape of each token seen; emptied when it holds ``room`` of them."""

    def __init__(self, room: int = 100_000) -> None:
        super().__init__()
        self.room = room

    def __missing__(self, token: str) -> str:
        if not token[0].isalnum() and token[0] != "_":
            shape = token
        elif token.isdigit():
            shape = "0"
        elif token.isupper() and len(token) > 1:
            shape = "X"
        else:
            shape = "Xx" if token[0].isupper() else "x"
        if len(self) >= self.room:
            self.clear()
        self[token] = shape
        return shape


_shapes = _Shapes()


def indicators(text: str) -> set[str]:
    tokens = _TOKEN.findall(text)
    shapes = list(map(_shapes.__getitem__, tokens))
    for k in [k for k, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False), 1) if a == b]:
        shapes[k] = "="
    out = set(text.lower().split())
    out.update(f"2 {a} {b}" for a, b in set(zip(shapes, shapes[1:], strict=False)))
    out.update(f"3 {a} {b} {c}" for a, b, c in set(zip(shapes, shapes[1:], shapes[2:], strict=False)))
    return out


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, n: int, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed indicator counts of the classes 1 and 0."""
    p, q = np.full(n, alpha), np.full(n, alpha)
    for own, label in zip(rows, y, strict=True):
        (p if label else q)[own] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, c: float = 1.0, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """Weights of the hinge-loss machine; the last one is the constant's. Classes weigh the same in total."""
    sign, w, alpha = np.where(y > 0, 1.0, -1.0), np.zeros(n + 1), np.zeros(len(y))
    bound = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y <= 0).sum())))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(y)):
            own, v = rows[i], values[i]
            g = sign[i] * (w[own] @ v + w[n]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), bound[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[own] += step * sign[i] * v
                w[n] += step * sign[i]
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w


class Classifier:
    """known: indicator -> (weight times ratio, squared ratio); score of margin m is sigmoid(a m + b)."""

    def __init__(self, known: dict[str, tuple[float, float]], constant: float, a: float, b: float) -> None:
        self.known, self.constant, self.a, self.b = known, constant, a, b
        self.fitted = a != 0.0

    def margin(self, text: str) -> float:
        total = square = 0.0
        known = self.known
        for f in sorted(indicators(text) & known.keys()):
            w, r = known[f]
            total += w
            square += r
        return total / math.sqrt(square) + self.constant if square else self.constant

    def scores(self, batch: list[str]) -> np.ndarray:
        return sigmoid(self.a * np.array([self.margin(t) for t in batch], dtype=np.float64) + self.b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000, max_indicators: int | None = None, least: int = 3) -> Classifier:
    """A classifier from at most ``per_class`` training texts of each class."""
    sample = materialize(training_texts(docs, labels, label, per_class), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(indicators(c.as_py())) for c in batch.column(0)], pa.list_(pa.string())), batch.column(1)], names=["found", "label"])

    found = materialize(sample.mapInArrow(run, "found array<string>, label int"), "quality-indicators")
    counts = found.select(F.explode("found").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = counts.orderBy(F.desc("n"), "f")
    names = [r["f"] for r in (common.limit(max_indicators) if max_indicators else common).collect()]
    number = {f: k for k, f in enumerate(names)}
    held = sample.sparkSession.sparkContext.broadcast(number)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [sorted(held.value[f] for f in c.as_py() if f in held.value) for c in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], names=["found", "label"])

    got = found.mapInArrow(numbered, "found array<int>, label int").toArrow()
    for read in (sample, found):
        discard(read)
    y = got.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return Classifier({}, 0.0, 0.0, 0.0)
    rows = [np.array(c.as_py(), dtype=np.int64) for c in got.column("found")]
    order = sorted(range(len(y)), key=lambda i: (y[i], rows[i].tobytes()))  # rows come in any order
    order = np.array(order)[np.random.default_rng(0).permutation(len(y))]
    y, rows = y[order], [rows[i] for i in order]
    seen = np.arange(len(y)) % 5 > 0
    if len(set(y[seen].tolist())) < 2 or len(set(y[~seen].tolist())) < 2:
        seen[:] = True
    at = np.flatnonzero(seen)
    ratio = log_count_ratios([rows[i] for i in at], y[at], len(names))
    values = [v / (np.linalg.norm(v) or 1.0) for v in (ratio[i] for i in rows)]
    w = dual_coordinate_descent([rows[i] for i in at], [values[i] for i in at], y[at], len(names))
    rest = np.flatnonzero(~seen) if not seen.all() else at
    margins = np.array([w[rows[i]] @ values[i] + w[-1] for i in rest])
    a, b = logistic(margins[:, None], y[rest], ridge=1.0)
    return Classifier({f: (float(w[k] * ratio[k]), float(ratio[k] ** 2)) for f, k in number.items()}, float(w[-1]), float(a), float(b))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score)."""
    src = texts(docs, id_col, text_col)
    held = src.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores([c.as_py() for c in batch.column(1)]))], names=["id", "score"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Classifier, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that score at least ``least``; all of them if the model was fitted to nothing."""
    if not model.fitted:
        return docs
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(held.value.scores([c.as_py() or "" for c in batch.column(at)]) >= least))

    return docs.mapInArrow(run, docs.schema)
