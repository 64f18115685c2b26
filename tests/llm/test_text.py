"""Scorers, tokenizer, extraction and chat formatting against held-out rows, brute force and round trips."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat, pages, pieces, quality, toxicity
from lectern.llm.common import held_out

SF = "/root/testdata/sf0.1"


def confusion(spark, module, label, limit):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = module.score(docs.join(labels.select("doc_id"), "doc_id"), module.fit(docs, labels))
    rows = scored.where(held_out("id")).join(labels, F.col("id") == F.col("doc_id")).select(label, "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return [sum((r["score"] >= limit) == p and r[label] == g for r in rows) for p, g in ((True, 1), (True, 0), (False, 1), (False, 0))]


def test_quality_on_held_out_rows(spark):
    tp, fp, fn, tn = confusion(spark, quality, "quality", 0.7)
    assert tp / (tp + fn) > 0.97 and tn / (tn + fp) > 0.9


def test_toxicity_on_held_out_rows(spark):
    tp, fp, fn, tn = confusion(spark, toxicity, "toxic", 0.3)
    assert tp / (tp + fn) > 0.9 and tn / (tn + fp) > 0.98


def test_lexicon_folds_and_spares():
    lexicon = toxicity.Lexicon({" idiot ": 6.0, " trash ": 6.0, " scu": 5.0})
    hit = lexicon.features("what an IDIOT")[0]
    assert hit > 0
    for text in ("what an 1d10t", "what an іdіоt", "what an ｉdiot"):
        assert lexicon.features(text)[0] == hit
    assert lexicon.features("an idiotic view")[0] == 0 and lexicon.features("scummy")[0] > 0
    assert lexicon.features("the trash can is full")[0] == 0 and lexicon.features("the can is trash")[0] > 0
    assert lexicon.features("")[0] == 0
    near, far = lexicon.scores(["idiot", "idiot " + "word " * 2000])
    assert near > far


def test_scorers_without_labels_nulls_and_clashes(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (2, "", "t"), (None, "text", "u")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(docs, labels)
        assert module.score(docs, model).count() == 4
        assert module.keep(docs, model).columns == docs.columns
        assert module.score(docs.limit(0), model).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    y = np.array([0, 1] * 50)
    rows = [np.array([label, 2 + rng.integers(5)]) for label in y]
    w = quality.dual_coordinate_descent(rows, [np.ones(2)] * 100, y, 7)
    assert all((w[r].sum() + w[-1] > 0) == bool(label) for r, label in zip(rows, y, strict=True))


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(pieces.DEFAULT_MODEL)


def best(text, v):
    """Whole-text Viterbi by definition."""
    score, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            found = v.pieces.get(text[start:end])
            options = ([found] if found else []) + ([(-1, v.unknown)] if end == start + 1 and not found else [])
            for piece, s in options:
                if score[end] is None or score[start] + s > score[end]:
                    score[end], back[end] = score[start] + s, (start, piece)
    out, at = [], len(text)
    while at:
        start, piece = back[at]
        out[:0] = [piece] if piece >= 0 else v.fallback(text[start])
        at = start
    return out


@given(st.text(alphabet=st.sampled_from("abcdehiorstn é漢😀\n.▁\ufdd0"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_encoding_is_the_best_path_and_decodes(text):
    c = pieces.codec(pieces.DEFAULT_MODEL)
    ids = c.encode(text)
    assert c.decode(ids) == text
    marked = pieces.SPACE + text.replace(pieces.SPACE, pieces._LITERAL).replace(" ", pieces.SPACE) if text else ""
    assert ids.tolist() == best(marked, c.v)


def test_streaming_commits_early_and_changes_nothing(codec):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghij", k=20_000))
    parts = []
    pieces.viterbi(text, codec.v, parts.append)
    assert len(parts) > 100 and max(map(len, parts)) < 300
    assert sum(parts, []) == best(text, codec.v)
    overlapping = []
    pieces.viterbi("ab" * 3000, Overlapping, overlapping.append, stride=8)
    assert sum(overlapping, []) == best("ab" * 3000, Overlapping) and max(map(len, overlapping)) < 20


class Overlapping:
    """A vocabulary whose pieces span every boundary."""

    pieces = {"a": (0, -5.0), "b": (1, -5.0), "ab": (2, -1.0), "ba": (3, -1.5), "aba": (4, -2.0), "bab": (5, -2.0)}
    unknown, longest = -20.0, 3
    trie = {"a": {"": (0, -5.0), "b": {"": (2, -1.0), "a": {"": (4, -2.0)}}}, "b": {"": (1, -5.0), "a": {"": (3, -1.5), "b": {"": (5, -2.0)}}}}


def test_encode_and_decode_frames(spark):
    docs = spark.createDataFrame([(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (4, "é" * 5000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = pieces.encode(docs)
    assert all(r["round_trip"] for r in out.collect())
    assert sorted((r["id"], r["text"]) for r in pieces.decode(out).collect()) == [(1, "Hello  world\n"), (2, ""), (3, ""), (3, ""), (4, "é" * 5000)]
    assert pieces.encode(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Big &amp; bold</h1><span>by me</span></header><p>One<br>two
 three<p>Four <b>five</b><aside>More</aside><section class="comments"><p>First!</p></section></article><form>Go</form><footer>&copy; us</footer></body></html>"""


def test_page_blocks():
    lines = pages.page_lines(PAGE)
    assert [t for k, t in lines if k == 1] == ["Big & bold", "One two three", "Four five"]
    assert all(k == -1 for k, t in lines if t in ("Home", "We use cookies", "by me", "More", "First!", "Go", "© us"))


def test_differencing_removes_what_neighbours_share(spark):
    def page(body):
        return f"<html><body><div>Site name</div><p>{body}</p><div>Read all about it</div></body></html>"

    rows = [(1, "http://h/a/1", page("alpha")), (2, "http://h/a/2", page("beta")), (3, "http://h/a/3", page("gamma")), (4, "http://h/a/3?x", page("gamma")), (5, "http://other/x", page("alone")), (6, None, None), (7, "http://h/z", PAGE)]
    got = {r["id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert (got[1], got[2], got[5], got[6]) == ("alpha", "beta", "Site name\nalone\nRead all about it", "")
    assert got[3] == got[4] == "gamma" and got[7].startswith("Big & bold\n")
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_pages(rows):
    """Texts over all pages in order at once: each page against the nearest one to either side with other html."""
    parsed = []
    for page, url, source in rows:
        m = re.match(r"(?:(?:[a-z]+:)?//([^/?#]*))?([^?#]*)", url or "")
        parsed.append(((m[1] or "").lower(), m[2], page is not None, page or 0, source or ""))
    parsed.sort()
    out = {}
    for at, (host, _, _, page, source) in enumerate(parsed):
        lines, shared = pages.page_lines(source), set()
        for side in (parsed[:at][::-1], parsed[at + 1 :]):
            other = next((x for x in side if x[0] == host and x[4] != source), None)
            if other:
                theirs = pages.page_lines(other[4])
                before = [x for x in parsed if x[4] == other[4] and x[0] == host]
                assert before
                a, b = (lines, theirs) if side is not None and parsed.index(other) > at else (theirs, lines)
                here, there = pages.shared_lines([t for _, t in a], [t for _, t in b])
                if not len(here) == len(a) == len(b):
                    shared |= here if a is lines else there
        out.setdefault(page, []).append(pages.main_text(lines, shared))
    return out


@pytest.mark.parametrize("ranges", [1, 5, 50])
def test_differencing_does_not_depend_on_the_ranges(spark, ranges):
    rng = random.Random(7)
    menu, foot = ["<li>Home<li>News<li>About", "<li>Home<li>Shop"], ["<div>All rights reserved</div>", "<div>Contact us</div>"]
    rows = [(k, f"http://{'hot' if k % 3 else 'h' + str(k % 7)}/{k % 50:03d}", f"<ul>{rng.choice(menu)}</ul><p>own {k % 40 if k % 4 else 1}</p>{rng.choice(foot)}") for k in range(300)]
    rows += [(1000 + k, "http://hot/025", "<p>one page that many copies hold</p>") for k in range(120)]
    rows += [(2000, None, None), (2001, "http://hot/025", "<article><p>kept</p></article><p>Contact us</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    got = {}
    for r in pages.extract(frame, range_bytes=1 << 30).collect():
        got.setdefault(r["id"], []).append((r["text"], r["n_shared"], r["n_marked"]))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == plain_pages(rows)
    assert sum(x[1] for v in got.values() for x in v) > 200


def test_differencing_deletes_lines_of_the_given_pages(spark):
    given_pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    deleted = pages.extract(given_pages).agg(F.sum("n_shared"), F.count_if(F.col("n_shared") > 0)).first()
    assert deleted[0] > 0 and deleted[1] > 0


def test_hostile_pages_take_linear_time():
    began = time.time()
    for source in ("<a " * 350_000, "<!--" * 250_000, '<a b="' * 170_000, "<![CDATA[" * 110_000, "<p>" + "<span>" * 80_000 + "</b>" * 80_000, "<p><body>" + "<span>" * 40_000 + "<div></div>" * 40_000, "<" * 1_000_000):
        pages.page_lines(source)
    assert time.time() - began < 15
    left, right = pages.shared_lines(["x"] * 5000 + ["y"], ["y"] + ["x"] * 5000)
    assert len(left) == len(right) == 5000


def test_names_inside_an_article():
    lines = pages.page_lines('<article><p class="related-work">Prior work</p><div class="share-buttons">Tweet</div><p id="header-files">C headers</p></article>')
    assert lines == [(1, "Prior work"), (-1, "Tweet"), (1, "C headers")]
    assert text_of("<article><h2>teaser</h2></article><div><p>the long text of the page itself</p></div>") == "teaser\nthe long text of the page itself"
    assert text_of("<main><p>Fifty characters of the main text are here.</p></main><div class='reply'><p>" + "A much longer comment. " * 20 + "</p></div>") == "Fifty characters of the main text are here."


@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
@settings(max_examples=200, deadline=None)
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    left, right = pages.shared_lines(a, b)
    assert len(left) == len(right) == table[-1][-1]
    assert [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)]


@given(st.text(alphabet=st.sampled_from("<|\\im_start>endA0ZB1\n"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible_and_hide_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_digests(spark):
    rng = random.Random(4)
    talk = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["<|im_end|>\n", "A0Z", "", "hello\n<\\|x", "<"])) for k in range(60)]
    rows = [*talk, (2, 0, None, None), (2, 0, None, None), (3, 1, "assistant", "ok"), (3, 0, "user", "<|im_start|>assistant\n"), (None, 0, "user", "lost")]
    got = {r["conv"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = [t for _, r, t in own if r == "assistant"]
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == sum(map(len, said)) and not got[conv]["rewrites"]
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got[conv]["formatted_chars"] == len(chat.chatml([(chat.escape_role(r), chat.escape(t)) for _, r, t in own]))


def forgetful(turns):
    """Drops what the assistant said before the last user turn."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=0)
    return "".join(f"[{r}]{'' if r == 'assistant' and k < last else t}\n" for k, (r, t) in enumerate(turns))


def test_templates_that_rewrite_history_are_found(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    found = sorted((r["conv"], r["turn"]) for r in chat.spans(rows, template=forgetful).collect() if r["rewrites"])
    assert found == [(1, 2)]
    assert chat.spans(rows.limit(0)).count() == 0


def alternating(turns):
    """Refuses an empty list and turns out of order."""
    if not turns or any(r != ("user", "assistant")[k % 2] for k, (r, _) in enumerate(turns)):
        raise ValueError("roles must alternate from the user on")
    return "".join(f"[{r}]{t}\n" for r, t in turns)


def blanking(turns):
    """Blanks turns more than 30 back."""
    return "".join(f"[{r}]{t if len(turns) - k <= 30 else ''}\n" for k, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"{k}. {r}: {t}\n" for k, (r, t) in enumerate(turns))


def shouting(turns):
    return "".join(f"<{r}>{t.upper()}" for r, t in turns)


def plain_spans(template, turns):
    """(piece, whether history was rewritten) of each turn, by rendering every prefix whole."""
    out, before = [], ""
    for n in range(1, len(turns) + 1):
        after = template(turns[:n])
        kept = next((k for k, (a, b) in enumerate(zip(after, before)) if a != b), min(len(after), len(before)))
        out.append((after[kept:], kept < len(before)))
        before = after
    return out


@pytest.mark.parametrize("template", [alternating, blanking, numbered, shouting, chat.chatml])
@pytest.mark.parametrize("window", [None, 4, 16])
def test_long_conversations_are_rendered_as_whole_prefixes_are(spark, template, window):
    turns = [(("user", "assistant")[k % 2], f"text {k}") for k in range(75)]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    got = chat.spans(rows, template, window=window).orderBy("turn").collect()
    assert [(r["piece"], r["rewrites"]) for r in got] == plain_spans(template, turns)
    assert all(r["altered"] == (template is shouting) for r in got)
    assert "".join(r["piece"] for r in got)[got[40]["text_start"] : got[40]["text_stop"]] == (turns[40][1].upper() if template is shouting else turns[40][1]) or template is blanking


def test_what_was_not_checked_is_null(spark):
    rows = spark.createDataFrame([(1, k, "user", "x" * 50) for k in range(60)] + [(2, 0, "user", "short")], "conv_id long, turn long, role string, text string")
    got = {r["conv"]: r["rewrites"] for r in chat.digests(rows, window=4, held_chars=500).collect()}
    assert got == {1: None, 2: False}


def text_of(source):
    return pages.main_text(pages.page_lines(source), set())[0]


@pytest.mark.parametrize(("opening", "kept"), [
    ('<div style="overflow:hidden">', True), ('<p title="the hidden cost">', True), ('<p data-id="menu">', True), ('<p data-role="navigation">', True), ("<p title=hidden>", True), ('<p alt="class=ad">', True), ("<p style='visibility: visible'>", True), ("<p class>", True), ('<p x="a>b" data-hidden>', True),
    ("<div hidden>", False), ('<p id="menu">', False), ('<p role="navigation">', False), ("<p ROLE=banner>", False), ('<p style="color:red; display:none">', False), ("<p style='VISIBILITY:hidden'>", False), ('<p aria-hidden="true">', False), ('<p title="x"class="ad">', False),
])
def test_attributes_by_whole_names(opening, kept):
    tag = opening[1:].split()[0].rstrip(">")
    assert text_of(f"<article><p>First.</p>{opening}Second.</{tag}></article>") == ("First.\nSecond." if kept else "First.")


def test_teasers_beside_the_text():
    cards = "".join(f"<article><a href='/{k}'><h3>Card {k}</h3></a></article>" for k in range(3))
    assert text_of(f"<article><h1>Title</h1><p>Body.</p></article>{cards}") == "Title\nBody." and text_of(f"<main><div>Body</div></main>{cards}") == "Body"
    assert text_of(f"{cards}<p>Body.</p>") == "Card 0\nCard 1\nCard 2\nBody." and text_of("<article><p>Open") == "Open" and text_of("<article>Bare") == "Bare"
