"""Main text of web pages by differencing each page with its nearest neighbours.

Pages of a host are sorted by URL path; neighbours in that order are paired, and their text lines (blocks) are
aligned by longest common subsequence. Lines that a pair shares are the site's own and are deleted first. Markup then
settles what differencing can't: the lines of an ``article`` or ``main`` element are spared, since copies of pages and
quoted passages are shared too, and what lies in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments goes where neighbours have other words there. Of what is left, the text is the main part, or
all of it if there is none. An ``article`` without any paragraph is a teaser and no main part.

The nearest page to either side whose html differs is a page's neighbour (copies are no pair), and a pair with all
lines the same says nothing. Pages are dealt by ranges of (host, path), so a host of any size spreads over many tasks;
the page that a range's first or last page has as neighbour is sent to that range too, so results don't depend on the
ranges. Where the ranges begin and which pages are sent twice (ten rows a range at most) is all that the driver sees.

Time is linear in a page's length but for the alignment, which takes lines times lines of bit operations, 64 at once.

Defined cases: null html is an empty page with empty text; pages without a host form one group; repeated pages
give one row each; pages at one URL are ordered by id (null first); further columns are ignored; broken markup is read
as browsers do in the simple cases (an end tag closes what is open inside, an end tag without a start is skipped, a tag
or comment without an end runs to the end of the page).
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.storage import discard, materialize

# Elements without content, raw-text elements, block elements and elements that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav header footer aside form head dialog menu button select svg object canvas audio video".split())
MAIN = frozenset(("article", "main"))
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

# Every alternative ends at the end of the page at the latest, so no start is tried twice.
_TAG = re.compile(
    r"""<!---?>|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?|["'=/]""")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
_END_OF = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_RANGES = 16_384  # bounds what the driver sees, ten rows a range
_NO_WORD = re.compile(r"[^a-z0-9]+")
# Words that with a mark before them name a box of that kind inside an article.
BOXES = frozenset("area bar block box button buttons container form frame inner links list outer panel section slot thread unit widget wrap wrapper".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = BLOCK - {"body", "html", "head"}


def _unwanted(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in DROPPED:
        return not (tag == "header" and inside_main)  # an article's own header has its headings
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES) or (name == "style" and _INVISIBLE.search(value)):
                return True
            if name in ("class", "id") and tag not in MAIN and tag not in ("body", "html"):
                if inside_main:
                    if any(_boxed(_NO_WORD.split(v)) for v in value.split()):
                        return True
                elif not MARKS.isdisjoint(_NO_WORD.split(value)):
                    return True
    return False


def _boxed(parts: list[str]) -> bool:
    """Whether a class name means such a box as a whole; "related-work" or "share-price" may be an article's subject."""
    return parts[0] in MARKS and all(p in MARKS or p in BOXES for p in parts[1:])


def page_lines(source: str) -> list[tuple[int, str]]:
    """(kind, text) of each block with text: 1 inside the main part, 0 outside, -1 by markup never main text."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, kind, whether it is an article's header
    blocks: list[int] = []  # where the stack's block elements are
    opened: Counter = Counter()  # tags on the stack
    kind, header, at = 0, False, 0
    article, began, paragraphs = -1, 0, False  # depth of an article that no other main part holds, its first line, whether it has paragraphs

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((kind, text))

    def close(depth: int) -> None:
        nonlocal kind, header, article
        if article >= depth:
            if not paragraphs:
                out[began:] = [(min(k, 0), t) for k, t in out[began:]]
            article = -1
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1
        while blocks and blocks[-1] >= depth:
            blocks.pop()
        kind, header = (stack[-1][1], stack[-1][2]) if stack else (0, False)

    while True:
        m = _TAG.search(source, at)
        if m is None:
            parts.append(source[at:])
            break
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        if m[3] is None:
            parts.append(m["data"] or "")
            continue
        tag = m[3].lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[2]:
            if opened[tag]:
                close(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth][0] == tag))
            continue
        if tag in RAW:
            end = _END_OF[tag].search(source, at)
            at = end.start() if end else len(source)
            continue
        if tag in VOID or m[4].endswith("/") and tag not in BLOCK:
            continue
        if tag in _CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        own = kind
        if kind >= 0 and _unwanted(tag, m[4], kind == 1):
            own = -1
        elif kind >= 0 and tag in MAIN:
            if kind == 0 and tag == "article":
                article, began, paragraphs = len(stack), len(out), False
            own = 1
        if tag == "p" and own == 1:
            paragraphs = True
        if header and kind == -1 and tag in _HEADINGS:
            own = 1
        inner = header or (tag == "header" and kind == 1)
        if tag == "header" and kind == 1:
            own = -1
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, own, inner))
        opened[tag] += 1
        kind, header = own, inner
    flush()
    close(0)
    return out


def shared_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Numbers of the lines of a and of b on a longest common subsequence.

    Bit-parallel rows (Hyyro, 2004): bit j of row i is 0 where line j of b adds one to the length. Only every ``step``-th
    row is kept and those between are made again on the way back, so memory is lines times the square root of lines bits.
    """
    masks: dict[str, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full, step = (1 << len(b)) - 1, math.isqrt(len(a)) + 1

    def rows(first: int, row: int) -> Iterator[int]:
        for line in islice(a, first, None):
            yield row
            match = masks.get(line, 0)
            row = ((row + (row & match)) | (row & ~match)) & full
        yield row

    kept = list(islice(rows(0, full), 0, None, step))
    left, right = set(), set()
    i, j, base, part = len(a), len(b), len(a) + 1, []
    while i and j:
        if i - 1 < base:
            base = (i - 1) // step * step
            part = list(islice(rows(base, kept[base // step]), step + 1))
        if part[i - base] >> (j - 1) & 1:
            j -= 1
        elif not part[i - 1 - base] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            left.add(i)
            right.add(j)
    return left, right


def main_text(lines: list[tuple[int, str]], shared: set[int]) -> tuple[str, int, int]:
    """(text, lines that differencing deletes, lines that markup deletes of the rest)."""
    left = [(k, t) for i, (k, t) in enumerate(lines) if k == 1 or i not in shared]
    kept = [(k, t) for k, t in left if k >= 0]
    if any(k == 1 for k, _ in kept):
        kept = [(k, t) for k, t in kept if k == 1]
    return "\n".join(t for _, t in kept), len(lines) - len(left), len(left) - len(kept)


class _Neighbours:
    """Takes the pages of a range in order and gives their texts back in order."""

    def __init__(self) -> None:
        self.page: tuple | None = None  # host and content of the page that waits for the next one
        self.lines: list[tuple[int, str]] = []
        self.shared: set[int] = set()
        self.rows: list[tuple] = []  # it and its copies; a page that is another range's gives none

    def done(self) -> Iterator[tuple]:
        if self.rows:
            found = main_text(self.lines, self.shared)
            yield from ((*row, *found) for row in self.rows)
            self.rows = []

    def take(self, page_id, url: str, host: str, content: int, source: str, guest: bool) -> Iterator[tuple]:
        rows = [] if guest else [(page_id, url)]
        if self.page == (host, content):
            self.rows += rows
            return
        lines, shared = page_lines(source), set()
        if self.page and host == self.page[0]:
            here, there = shared_lines([t for _, t in self.lines], [t for _, t in lines])
            if not len(here) == len(lines) == len(self.lines):
                self.shared |= here
                shared = there
        yield from self.done()
        self.page, self.lines, self.shared, self.rows = (host, content), lines, shared, rows


def _key(host: str, path: str, page_id, content: int) -> tuple:
    """Orders as Spark does: null ids come first."""
    return host, path, page_id is not None, page_id if page_id is not None else 0, content


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: its first and last page and, of their hosts, those around the first two and last two changes
    of content. Among them is the nearest page with other content of any page of another range at its edge."""

    def told(runs: list) -> list:
        return [page for run in runs for page in run]

    first, last, schema = None, None, None
    for batch in batches:
        schema = batch.schema
        for page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is None or page[0] != last["host"]:
                if first is None and last is not None:
                    first = told(last["front"] + last["back"])
                last = {"host": page[0], "front": [], "back": []}
            if last["back"] and last["back"][-1][0][3] == page[3]:
                last["back"][-1][1] = page
                continue
            last["back"] = [*last["back"][-1:], [page, page]]
            if len(last["front"]) < 2:
                last["front"].append(last["back"][-1])
    if last:
        pages = list(dict.fromkeys([*(first or []), *told(last["front"] + last["back"])]))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*pages, strict=True), schema, strict=True)]
        lead = pa.array([k == 0 for k in range(len(pages))])
        yield pa.RecordBatch.from_arrays([*columns, lead], names=[*schema.names, "lead"])


def _ranges(light: DataFrame, n: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """(the first key of each range, the further ranges to which pages go)."""
    names = ["host", "path", "id", "content"]
    ordered = light.select(*names).repartitionByRange(n, *names).sortWithinPartitions(*names)
    found = ordered.mapInArrow(_ends, f"host string, path string, id {light.schema['id'].dataType.simpleString()}, content long, lead boolean").collect()
    pages = sorted((_key(*r[:4]), r["lead"]) for r in found)
    keys = [k for k, _ in pages]
    starts = [k for k, lead in pages if lead]
    guests: dict[tuple, set[int]] = {}
    for part, start in enumerate(starts):
        at = bisect_left(keys, start)
        end = bisect_left(keys, starts[part + 1]) if part + 1 < len(starts) else len(keys)
        for edge, outside in ((keys[at], reversed(keys[:at])), (keys[end - 1], keys[end:])):
            for other in outside:
                if other[0] != edge[0]:
                    break
                if other[4] != edge[4]:
                    guests.setdefault(other, set()).add(part)
                    break
    return starts, {k: sorted(v) for k, v in guests.items()}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_bytes: int = 32 << 20) -> DataFrame:
    """(id, url, text, n_shared, n_marked): the main text of each page, and how many lines differencing and markup took.

    A range holds pages of about ``range_bytes``, or more where that makes over ``_RANGES``: a range streams, so its size
    costs no memory. There is at least one for each shuffle partition.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = src.withColumns({
        "host": F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)),
        "path": F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1),
        "content": F.xxhash64("html"),
    })
    light = materialize(keyed.select("host", "path", "id", "content", F.octet_length("html").cast("long").alias("size")), "page-keys")
    count, size = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts, guests = _ranges(light, max(1, min(math.ceil(size / range_bytes), _RANGES), min(count, least)))
    discard(light)
    held = src.sparkSession.sparkContext.broadcast((starts, guests))

    @F.arrow_udf("array<int>")
    def ranges_of(host: pa.Array, path: pa.Array, page_id: pa.Array, content: pa.Array) -> pa.Array:
        starts, guests = held.value
        keys = map(_key, host.to_pylist(), path.to_pylist(), page_id.to_pylist(), content.to_pylist())
        return pa.array([[max(0, bisect_right(starts, k) - 1), *guests.get(k, ())] for k in keys], pa.list_(pa.int32()))

    dealt = keyed.select("id", "url", "host", "path", "content", "html", F.posexplode(ranges_of("host", "path", "id", "content")).alias("guest", "part"))
    ordered = dealt.repartitionById(max(1, len(starts)), "part").sortWithinPartitions("host", "path", "id", "content").select("id", "url", "host", "content", "html", F.col("guest") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = _Neighbours(), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "url", "text", "n_shared", "n_marked"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(batch.num_rows):
                for row in state.take(*(batch.column(c)[at].as_py() for c in range(6))):
                    held.append(row)
                    size += len(row[2])
                    if size > 8 << 20:
                        yield out(held)
                        held, size = [], 0
        if kind is not None:
            yield out([*held, *state.done()])

    return ordered.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, url string, text string, n_shared long, n_marked long")
