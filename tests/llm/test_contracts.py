"""The registered queries that SQL can't express, against plain versions over the whole small tables."""

import html
import re
import zlib

import numpy as np
import pytest

from lectern.llm import chat, pieces, queries_scan, registry
from tests.llm.test_dedup import plain_components, plain_fingerprint
from tests.llm.test_scan import plain_nearest
from tests.llm.test_text import best

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize(("name", "limit"), [("op1_quality", 0.7), ("op3_toxicity", 0.3)])
def test_scores(spark, docs, name, limit):
    rows = run(spark, name)
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in docs]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)


def test_sentencepiece(spark, docs):
    v, got = pieces.codec(pieces.DEFAULT_MODEL).v, {r["doc_id"]: r for r in run(spark, "op2_sentencepiece")}
    assert set(got) == {i for i, _ in docs} and all(r["round_trip"] for r in got.values())
    for i, t in docs:
        if len(t) < 1500:
            assert got[i]["ids"] == best(pieces.SPACE + t.replace(" ", pieces.SPACE), v) and got[i]["n_tokens"] == len(got[i]["ids"])


def test_main_text(spark):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = run(spark, "op6_main_text")
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article[^>]*>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", " " if "br" in b[:3] else "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>|<br>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, points = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = plain_nearest(points, ids, [i for i in ids if i % 100 == 0], 10)
    got = {}
    for r in sorted(run(spark, "op7_nearest"), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-14, atol=0)


def test_simhash(spark, docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    want = plain_components([i for i, _ in docs], fps, 3)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op9_simhash")} == {(i, f"{f:016x}", want[i]) for (i, _), f in zip(docs, fps, strict=True)}


def test_chat_query_renders_whole_prefixes(spark, monkeypatch):
    """A template that blanks the first turn while a conversation has 33 to 60 turns is told by the registered query's own call."""
    def sly(turns):
        return "".join(chat.chatml([(r, "" if not k and 33 <= len(turns) <= 60 else t)]) for k, (r, t) in enumerate(turns))

    plain_digests = chat.digests
    monkeypatch.setattr(queries_scan.chat, "digests", lambda rows, **asked: plain_digests(rows, template=sly, **asked))
    long = spark.createDataFrame([(c, k, "user", f"turn {k}") for c, n in ((1, 70), (2, 20)) for k in range(n)], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(queries_scan, "table", lambda *_: long)
    assert {r["conv_id"]: r["rewrites"] for r in queries_scan.op10_chat(spark, "").collect()} == {1: True, 2: False, -1: False}
