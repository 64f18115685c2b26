"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A run of tokens is the encoding of its bytes exactly if each two neighbours are compatible: the merges, taken in order
of rank, never cross the border between them. So no merge is carried out at all. An Aho-Corasick automaton gives the
longest token that begins at each byte; the encoder takes it if it is compatible with the token before, else the
longest token that is a prefix of it, and steps back where none fits. A place from which no way leads on is marked and
not entered again, so the work is linear in the bytes. Compatible pairs are found by walking both tokens' edges through
the merges and kept in a table.

Decoding looks the ids' bytes up in one string of all tokens by a table of offsets.

Texts are cut where white space follows something else: the pattern that cuts a text into words has a border there
always. What lies between two such places is encoded on its own and its ids are kept in a bounded table.

The vocabulary file is handed to the executors with the job; none needs to have it. A file with features that are not
byte-level BPE as described (a normalizer, dropout, prefixes, ids for unknown words) is refused.

Defined cases: null and empty texts give no ids and an empty text; the strings of special tokens inside a text give the
special ids (``specials=False``: they are plain text); a text of any length is encoded in parts of about a million
characters, so memory beside the ids is bounded; repeated rows give one row each; ids that the vocabulary has not are
skipped by decode, as are nulls; bytes that are not UTF-8 are decoded to U+FFFD; the results have named columns of
their own, so others can't clash; empty tables stay empty.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from pathlib import PurePath

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import texts

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# The pattern that cuts texts into words, and the characters that Unicode counts as white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PART = 1 << 20  # characters of a long text that are encoded at once
_SHORT = 64  # longer words are not kept
_AHEAD = 4096  # bytes that the automaton is given at once


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file, the automaton and the tables of the encoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, before = given["model"], given["pre_tokenizer"] or {}
        if model.get("type") != "BPE" or given["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError("only byte-level BPE without normalizer and added space is read")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("the model has features beyond merges of bytes")
        added = [t for t in given["added_tokens"] if t["content"]]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take white space or whole words only are not read")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ids = model["vocab"]
        size = max([*ids.values(), *(t["id"] for t in added)]) + 1
        self.tokens = [b""] * size
        for text, i in ids.items():
            self.tokens[i] = bytes(map(byte_of.__getitem__, text))
        self.specials = {t["content"]: t["id"] for t in added}
        for text, i in self.specials.items():
            self.tokens[i] = text.encode()
        self.known = np.array([bool(t) for t in self.tokens])
        self.merged: dict[int, tuple[int, int]] = {}  # by id of two tokens: rank and id of what they become
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            if self.parts[whole] or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError("each token must come from one merge, of tokens that come before it")
            self.merged[a * size + b] = (rank, whole)
            self.parts[whole], self.rank[whole] = (a, b), rank
        self.size = size
        self.ids = {self.tokens[i]: i for i in ids.values() if self.parts[i] is None or self._first_crossing(*self.parts[i]) == self.rank[i]}
        self.length = [len(t) for t in self.tokens]
        self.widest = max(self.length)
        if self.widest > _AHEAD // 2:
            raise ValueError("a token is too long")
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in self.tokens]
        self.longest = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.longest.add_word(token.decode("latin-1"), i)
        self.longest.make_automaton()
        self.fits: dict[int, bool] = {}
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.at = np.r_[0, np.cumsum(self.length)].astype(np.int64)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one end of a token as its merges go on, each with the rank of the merge that takes it in."""
        out, until = [], len(self.rank) + 1
        while True:
            out.append((token, until))
            if self.parts[token] is None:
                return out[::-1]
            until, token = self.rank[token], self.parts[token][side]

    def _first_crossing(self, left: int, right: int) -> int | None:
        """Rank of the first merge across the border of two tokens. Of merges of one rank the leftmost comes first."""
        ends, starts = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            found = self.merged.get(a * self.size + b)
            if found is not None and found[0] < a_until and found[0] <= b_until:
                return found[0]
            if i + 1 < len(ends) and (a_until <= b_until or j + 1 == len(starts)):
                i += 1
            elif j + 1 < len(starts):
                j += 1
            else:
                return None

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        out = self.fits.get(key)
        if out is None:
            if len(self.fits) >= 1 << 20:
                self.fits.clear()
            out = self.fits[key] = self._first_crossing(left, right) is None
        return out

    def search(self, word: bytes) -> list[int]:
        """The encoding of a word's bytes."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, size, length, shorter, fits, compatible = len(word), self.size, self.length, self.shorter, self.fits, self.compatible
        text, longest, sure = word.decode("latin-1"), self.longest.iter_long, _AHEAD - self.widest
        out: list[int] = []
        closed, at, last, ahead, until = bytearray(n + 1), 0, -1, longest(text[:_AHEAD]), sure
        token = first = next(ahead)[1]  # first: the longest at ``at``, the one that ``ahead`` has given
        while at < n:
            while token >= 0 and (closed[at + length[token]] or last >= 0 and not (fits.get(last * size + token) or compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last = token
                if at < n:
                    if token != first or at > until:
                        ahead, until = longest(text[at : at + _AHEAD]), at + sure
                    token = first = next(ahead)[1]
            elif out:
                closed[at] = 1
                out.pop()
                at -= length[last]
                token, first, last = shorter[last], -1, out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return out


class _Pieces(dict):
    """Ids, as bytes, of what lies between two borders. When ``room`` short ones are held they become the old ones, from
    which those that come again are taken back."""

    def __init__(self, v: Vocabulary, room: int) -> None:
        super().__init__()
        self.v, self.room, self.words = v, room, regex.compile(WORDS)
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            bare = piece[1:] if piece[0] == " " else piece
            words = [piece] if bare.isascii() and bare.isalpha() else self.words.findall(piece)
            out = array("i", [i for w in words for i in self.v.search(w.encode("utf-8", "replace"))]).tobytes()
        if len(piece) < _SHORT:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about ``_PART`` characters, each but the first beginning with a space that follows a letter
    or sign; one without such a place is a part of its own."""
    at = 0
    while len(text) - at > _PART:
        cut = at + _PART
        while (cut := text.find(" ", cut)) >= 0 and text[cut - 1].isspace():
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Codec:
    def __init__(self, path: str, room: int = 400_000) -> None:
        self.v = Vocabulary(path)
        self.held = _Pieces(self.v, room)
        self.pieces = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.v.specials, key=len, reverse=True))) + ")") if self.v.specials else None

    def _plain(self, text: str) -> bytes:
        get = self.held.__getitem__
        return b"".join([b"".join(map(get, self.pieces.findall(part))) for part in parts(text)])

    def encode(self, text: str, specials: bool = True) -> np.ndarray:
        if specials and self.special and any(s in text for s in self.v.specials):
            cut = self.special.split(text)
            return np.frombuffer(b"".join(array("i", [self.v.specials[s]]).tobytes() if k % 2 else self._plain(s) for k, s in enumerate(cut)), dtype=np.int32)
        return np.frombuffer(self._plain(text), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        v = self.v
        ids = ids[(ids >= 0) & (ids < v.size)]
        starts = v.at[ids]
        sizes = v.at[ids + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ends):
            return ""
        places = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])
        return v.bytes[places].tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}  # one in each Python worker


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def shipped(spark: SparkSession, file: str) -> Callable[[], str]:
    """Where a file that the job carries to its executors lies there."""
    spark.sparkContext.addFile(file)
    name = PurePath(file).name
    return lambda: SparkFiles.get(name)


def by_size(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows`` rows at most, whose cells of a column have ``most`` bytes unless one alone has more."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).cast(pa.binary()).fill_null(b"").to_pandas().map(len).to_numpy(dtype=np.int64)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, to - at)
            at = to


def int_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, specials: bool = True, decoded: bool = False) -> DataFrame:
    """(id, ids, n_tokens), and with ``decoded`` the text that the ids decode to."""
    src = texts(docs, id_col, text_col)
    path = shipped(src.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            own = codec(path())
            ids = [own.encode(cell.as_py(), specials) for cell in batch.column(1)]
            columns = {"id": batch.column(0), "ids": int_lists(ids), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            if decoded:
                columns["text"] = pa.array([own.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>, n_tokens long" + ", text string" * decoded)


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text) of id lists; a null list is an empty text."""
    src = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].cast("array<int>").alias("ids"))
    path = shipped(src.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path())
            out = [own.decode(np.array([i for i in cell.as_py() or [] if i is not None], dtype=np.int32)) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string")
