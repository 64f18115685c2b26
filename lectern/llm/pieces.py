"""SentencePiece encoding by streaming Viterbi search, and decoding.

The best segmentation has the largest sum of the vocabulary's piece scores; of equal sums the longest last piece
wins. Scores are read from the file as they are, also from one whose scores are merge ranks. A character that no
piece covers costs ten more than the worst piece and is written as its UTF-8 bytes' pieces (or the unknown id).

Streaming: scores are kept for a window as long as the longest piece. At a boundary that no piece found so far spans
all surviving paths meet, and the ids before it are final; where pieces keep overlapping, the backpointers of the
window's states are followed every ``_STRIDE`` characters until they meet. Pairs of characters that no piece of the
vocabulary spans (a word's end and the next blank, a letter and a mark) are such boundaries in every text, so what lies
between them is searched on its own, and its ids are kept in a bounded table.

The model file is handed to the executors with the job; none needs to have it.

Defined cases: null and empty texts give no ids; a text of any length needs memory for its ids and the pending part
only; a literal U+2581 is written as bytes, so that decoding returns it, and so is every other character without a
piece; repeated rows give one row each.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import map_batches, texts

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_UNKNOWN_PENALTY = 10.0
_STRIDE = 64  # characters between looks for a common boundary
_LITERAL = "\ud800"  # stands for a literal U+2581 inside the encoder; a lone surrogate is in no text that Spark holds


class Vocabulary:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.trie: dict = {}  # by character; under "" the id and score of the piece that ends there
        for piece, found in self.pieces.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = found
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - _UNKNOWN_PENALTY
        self.unknown_id = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.inner = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}  # pairs that some piece spans
        self.split = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.raw = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                self.raw[i] = b""
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()

    def fallback(self, char: str) -> list[int]:
        data = (SPACE if char == _LITERAL else char).encode("utf-8", "replace")
        return [self.bytes[b] for b in data] if len(self.bytes) == 256 else [self.unknown_id]


def viterbi(chars: str, v: Vocabulary, emit: Callable[[list[int]], None], stride: int = _STRIDE) -> None:
    """Gives the ids of the best segmentation to ``emit``, part by part, each as soon as all surviving paths share it."""
    n, root, unknown = len(chars), v.trie, v.unknown
    base = reach = 0  # where the pending part begins, and the last boundary that a piece has reached
    score, back, ids = [0.0], [0], [-1]  # of the pending boundaries: best sum, start and id (-1: bytes) of the last piece

    def path(to: int) -> list[int]:
        out: list[int] = []
        while to:
            if ids[to] >= 0:
                out.append(ids[to])
            else:
                out.extend(reversed(v.fallback(chars[base + back[to]])))
            to = back[to]
        out.reverse()
        return out

    for i in range(n):
        at = i - base
        if i == reach and at:
            emit(path(at))
            base, at = i, 0
            score, back, ids = [0.0], [0], [-1]
        elif at >= stride and at % stride == 0:
            live = {k for k in range(at, len(score)) if score[k] > -math.inf}
            while len(live) > 1:
                top = max(live)
                live.remove(top)
                live.add(back[top])
            meet = live.pop()
            if meet:
                emit(path(meet))
                base, at = base + meet, at - meet
                del score[:meet], back[:meet], ids[:meet]
                back = [k - meet for k in back]
        here, end, node, whole = score[at], at + 1, root.get(chars[i]), False
        if end == len(score):
            score.append(-math.inf)
            back.append(at)
            ids.append(-1)
        if node is not None and "" in node:
            whole = True
        if not whole and here + unknown > score[end]:
            score[end], back[end], ids[end] = here + unknown, at, -1
        if reach <= i:
            reach = i + 1
        k = i + 1
        while node is not None:
            if "" in node:
                piece, value = node[""]
                while end >= len(score):
                    score.append(-math.inf)
                    back.append(at)
                    ids.append(-1)
                if here + value > score[end]:
                    score[end], back[end], ids[end] = here + value, at, piece
                if k > reach:
                    reach = k
            if k == n:
                break
            node = node.get(chars[k])
            k += 1
            end += 1
    if n > base:
        emit(path(n - base))


class _Words(dict):
    """Ids, as bytes, of the words seen. When ``room`` short ones are held they become the old ones, from which words
    that come again are taken back; what does not come again goes with the next change.

    A new word is cut where the vocabulary has no piece that spans the two characters: all paths meet there.
    """

    def __init__(self, v: Vocabulary, room: int) -> None:
        super().__init__()
        self.v, self.room = v, room
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self._searched(word)
        if len(word) < _STRIDE:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out

    def _searched(self, word: str) -> bytes:
        inner = self.v.inner
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inner]
        if cuts:
            return b"".join([self[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])
        ids = array("i")
        viterbi(word, self.v, ids.extend)
        return ids.tobytes()


class Codec:
    def __init__(self, path: str, room: int = 200_000) -> None:
        self.v = Vocabulary(path)
        self.words = _Words(self.v, room)
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.v.split else re.compile(r"(?s).+")

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        marked = SPACE + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.parts.findall(marked))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.v.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}  # one in each Python worker


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _shipped(spark: SparkSession, model: str) -> Callable[[], Codec]:
    """The codec of a model file that the job carries to its executors."""
    spark.sparkContext.addFile(model)
    name = PurePath(model).name
    return lambda: codec(SparkFiles.get(name))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, ids, n_tokens, round_trip): round_trip tells whether decoding the ids returned the text."""
    src = texts(docs, id_col, text_col)
    shipped = _shipped(src.sparkSession, model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, ids, same = shipped(), [], []
        for cell in batch.column(1):
            text = cell.as_py()
            got = own.encode(text)
            ids.append(got)
            same.append(own.decode(got) == text)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes), pa.array(same)], names=["id", "ids", "n_tokens", "round_trip"])

    return map_batches(src, work, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, text) of id lists; a null list is an empty text."""
    src = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))

    shipped = _shipped(src.sparkSession, model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shipped()
        out = [own.decode(np.array(cell.as_py() or [], dtype=np.int32)) for cell in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return map_batches(src, work, f"id {src.schema['id'].dataType.simpleString()}, text string")
