"""Chat formatting by incremental black-box rendering.

The template is a function from a list of (role, text) to a string and nothing else is known of it. Successive
turn prefixes are rendered; what a prefix adds to the output of the one before is the turn's span. An output that
does not begin with the one before shows a template that rewrites history. Two probe texts, rendered in the turn's
place, differ in their first and last character, so what their outputs share before and after is the turn's header and
footer; between them lies its text, the part under the loss mask for the trained roles.

Every prefix is rendered from the conversation's start, so the work grows with the square of a conversation's length.
With ``window`` the prefixes of longer conversations begin at most twice that many turns back, and whole prefixes are
rendered only when the turns have doubled and at the end. As long as those equal the pieces put together, the spans are
those of the whole output and the work is linear; if one differs, or the template refuses a cut prefix, the turns since
the last equal one are rendered from the start, exactly as without a window. What a window can't see is a template that
rewrites history and restores it before the next doubling. Whole prefixes are held for conversations of up to
``held_chars``; of longer ones ``rewrites`` is null unless a rewriting was seen: not checked.
A conversation streams through one task turn by turn.

Texts are escaped before rendering so that they cannot hold a control string: ``<``, any backslashes, ``|`` get one
more backslash. That is undone exactly on reading.

Defined cases: a template that refuses an empty list has no output for it; null text or role is empty; rows are ordered by turn (null first), then role, then text, so repeated
rows stay; a null conversation id is a conversation of its own; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
START, END = "<|im_start|>", "<|im_end|>"
PROBES = ("A0Z", "B0Y")
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chatml(turns: Turns) -> str:
    """The default template; roles and texts come escaped."""
    return "".join(f"{START}{role}\n{text}{END}\n" for role, text in turns)


def read_chatml(output: str) -> Turns:
    """The turns in a default template's output, unescaped."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(output)]


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Span(NamedTuple):
    """What a turn added to the output, where its text stands in that, and whether history was rewritten."""

    piece: str
    text_start: int
    text_stop: int
    rewrites: bool | None


class Incremental:
    """Spans of one conversation's turns, found by rendering prefixes. ``add`` and ``end`` give spans as they are final."""

    def __init__(self, template: Callable[[Turns], str], window: int | None = None, held_chars: int = 1 << 26) -> None:
        self.template, self.window, self.held_chars = template, window, held_chars
        self.turns: Turns = []  # of the prefix that is rendered next
        try:
            self.preamble = template([])  # an output for no turns belongs to no turn
        except Exception:  # noqa: BLE001 - a template may refuse it in any way
            self.preamble = ""
        self.before = self.preamble
        self.cut = False  # whether self.turns begins later than the conversation
        self.whole: Turns | None = []  # all turns, while they may be held
        self.equal, self.equal_to = 0, self.preamble  # turns and output of the last whole prefix that was as its pieces
        self.waiting: list[Span] = []  # since then
        self.chars, self.seen = 0, 0

    def _next(self, turns: Turns, before: str, role: str, text: str) -> tuple[Span, str]:
        after = self.template([*turns, (role, text)])
        rewrites = not after.startswith(before)
        at = _common(after, before) if rewrites else len(before)
        span = after[at:]
        a, b = (self.template([*turns, (role, p)])[at:] for p in PROBES)
        header = _common(a, b)
        footer = _common(a[header:][::-1], b[header:][::-1])
        return Span(span, header, max(header, len(span) - footer), rewrites), after

    def add(self, role: str, text: str) -> list[Span]:
        self.seen += 1
        self.chars += len(role) + len(text) + 1
        if self.whole is not None:
            self.whole.append((role, text))
        if self.cut:
            try:
                found, after = self._next(self.turns, self.before, role, text)
            except Exception:  # noqa: BLE001 - the template refuses a prefix that begins here
                if self.whole is None:
                    raise
                return self._again()
        else:
            found, after = self._next(self.turns, self.before, role, text)
        self.turns.append((role, text))
        self.before = after
        if self.window is None:
            return [found]
        self.waiting.append(found)
        if self.whole is None:
            return self._release(None)
        if self.chars > self.held_chars:
            out = self._check()
            self.whole = self.equal_to = None
            return out
        out = self._check() if self.seen >= 2 * max(self.equal, self.window) else []
        if self.window and len(self.turns) >= 2 * self.window:
            cut = self.turns[-self.window :]
            try:
                before = self.template(cut)
            except Exception:  # noqa: BLE001
                return out
            self.turns, self.before, self.cut = cut, before, True
        return out

    def _release(self, rewrites: bool | None) -> list[Span]:
        out = [s._replace(rewrites=s.rewrites or rewrites) for s in self.waiting]
        self.waiting = []
        return out

    def _check(self) -> list[Span]:
        """The waiting spans, after comparing the whole prefix with its pieces."""
        now = self.template(self.whole) if self.cut else self.before
        if now != self.equal_to + "".join(s.piece for s in self.waiting) and self.cut:
            return self._again()
        self.equal, self.equal_to = self.seen, now
        return self._release(False)

    def _again(self) -> list[Span]:
        """The waiting spans and the newest, rendered from the conversation's start; no window is used any more."""
        out, before = [], self.equal_to
        for k in range(self.equal, self.seen):
            found, before = self._next(self.whole[:k], before, *self.whole[k])
            out.append(found)
        self.window, self.cut, self.turns, self.before, self.waiting = None, False, self.whole, before, []
        self.whole = None
        return out

    def end(self) -> list[Span]:
        """The spans that still wait."""
        return self._check() if self.waiting and self.whole is not None else self._release(None)


SPANS = "conv {0}, turn long, role string, start long, stop long, text_start long, text_stop long, piece string, rewrites boolean, altered boolean"


class _Conversation:
    """Rows of one conversation, given out when their spans are final."""

    def __init__(self, conv, template: Callable[[Turns], str], window: int | None, held_chars: int) -> None:
        self.conv, self.state, self.at, self.rows = conv, Incremental(template, window, held_chars), 0, []
        self.lead = self.state.preamble

    def _out(self, spans: list[Span]) -> Iterator[tuple]:
        done, self.rows = self.rows[: len(spans)], self.rows[len(spans) :]
        for (turn, role, quoted), s in zip(done, spans, strict=True):
            piece, first = self.lead + s.piece, self.at + len(self.lead)
            yield self.conv, turn, role, self.at, self.at + len(piece), first + s.text_start, first + s.text_stop, piece, s.rewrites, s.piece[s.text_start : s.text_stop] != quoted
            self.at += len(piece)
            self.lead = ""

    def take(self, turn: int, role: str, text: str) -> Iterator[tuple]:
        quoted = escape(text)
        self.rows.append((turn, role, quoted))
        yield from self._out(self.state.add(escape_role(role), quoted))

    def end(self) -> Iterator[tuple]:
        yield from self._out(self.state.end())


def spans(conversations: DataFrame, template: Callable[[Turns], str] = chatml, window: int | None = None, held_chars: int = 1 << 26) -> DataFrame:
    """One row per turn, in order within each partition: its span of the conversation's output, the text's place in
    it, the output itself, whether the template rewrote history there, and whether it altered the text."""
    src = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = src.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in SPANS.split(", ")])

        for batch in batches:
            rows, kind = [], batch.schema.field(0).type
            for i in range(batch.num_rows):
                own, turn, role, text = (batch.column(c)[i].as_py() for c in range(4))
                if state is None or own != state.conv:
                    if state:
                        rows.extend(state.end())
                    state = _Conversation(own, template, window, held_chars)
                rows.extend(state.take(turn, role, text))
            if rows:
                yield out(rows)
        if state and (rows := list(state.end())):
            yield out(rows)

    return ordered.mapInArrow(run, SPANS.format(src.schema["conv"].dataType.simpleString()))


def digests(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",), template: Callable[[Turns], str] = chatml, reader: Callable[[str], Turns] = read_chatml, window: int | None = None, held_chars: int = 1 << 26) -> DataFrame:
    """Per conversation, read back from the output: turns, digests of turns and of the text under the loss mask, whether
    the template rewrote history (null: not checked to the end) and whether it altered a text."""
    found = spans(conversations, template, window, held_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, conv, state = None, object(), None

        def fresh() -> list:
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False, False]

        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites", "altered"])

        def row(conv, s: list) -> tuple:
            return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]

        for batch in batches:
            rows, kind = [], batch.schema.field(0).type
            for i in range(batch.num_rows):
                own, start, a, b, piece, rewrites, altered = (batch.column(c)[i].as_py() for c in (0, 3, 5, 6, 7, 8, 9))
                if own != conv:
                    if state:
                        rows.append(row(conv, state))
                    conv, state = own, fresh()
                for role, text in reader(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role in trained:
                        masked = unescape(piece[a - start : b - start])
                        state[2] += len(masked)
                        state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
                if state[5] is not True and rewrites is not False:
                    state[5] = rewrites
                state[6] |= altered
            if rows:
                yield out(rows)
        if state:
            yield out([row(conv, state)])

    return found.mapInArrow(run, f"conv {found.schema['conv'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, altered boolean")
