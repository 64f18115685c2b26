"""Byte-pair encoding and token alignment against the libraries that the vocabularies come from, and plain counting."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment, bpe, perfect, registry

SF = "/root/testdata/sf0.001"
BITS = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "'s", "'ll", "1", "२", "é", "ß", "中", "文", "😀", "́", "!", "<|endoftext|>", "<|endof", "<s>", "\x1c", "\x85", "\xa0", "​", " ", "½", "_", "-", "\r\n", ";\r", "{\r", "A", "ing", "tion", " the"]


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe.DEFAULT_VOCABULARY)


def test_encoder_equals_library(own, library):
    r = random.Random(7)
    letters = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2000))) for _ in range(60)]
    repeats = ["ab" * k + "a" * k + "aba" * k for k in range(60)]
    for text in [*odd_texts(4000), *letters, *repeats, "", " ", "\n"]:
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_special_strings_as_plain_text(own):
    library = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    library.encode_special_tokens = True
    for text in ("<|endoftext|>", "a <|endoftext|>b"):
        assert own.encode(text, specials=False).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_text_in_parts(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "_PART", 50)
    monkeypatch.setattr(bpe, "_AHEAD", 512)
    for text in ["the quick\n  brown  fox " * 40, "x" * 700, " \n" * 200, "".join(odd_texts(60))]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert "".join(bpe.parts(text)) == text


def test_pairs_of_tokens(own):
    """The table of compatible pairs against encoding both tokens' bytes by merges in order of rank."""
    v, r = own.v, random.Random(2)

    def merged(data):
        ids = [v.ids[bytes([b])] for b in data]
        while found := [(v.merged[a * v.size + b], -k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a * v.size + b in v.merged]:
            rank, whole = min(found)[0]
            out, k = [], 0
            while k < len(ids):
                pair = k + 1 < len(ids) and v.merged.get(ids[k] * v.size + ids[k + 1])
                out.append(whole if pair and pair[0] == rank else ids[k])
                k += 2 if pair and pair[0] == rank else 1
            ids = out
        return ids

    tokens = list(v.ids.values())
    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens[:3000])
        assert v.compatible(a, b) == (merged(v.tokens[a] + v.tokens[b]) == [a, b])


def test_decode_of_odd_lists(spark):
    df = spark.createDataFrame([(1, [15496, None, 995, 10**6, -1]), (2, None), (3, []), (4, [50256, 220])], "id int, ids array<int>")
    assert {r["id"]: r["text"] for r in bpe.decode(df).collect()} == {1: "Hello world", 2: "", 3: "", 4: "<|endoftext|> "}


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (1, "", 9), (2, "a b", 9), (2, "a b", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    rows = sorted(tuple(r) for r in bpe.encode(df, decoded=True).fillna(-1).collect())
    assert [(i, n, t) for i, _, n, t in rows] == [(-1, 1, "x"), (1, 0, ""), (1, 0, ""), (2, 2, "a b"), (2, 2, "a b")]
    assert bpe.encode(df.limit(0)).count() == 0


def test_bpe_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.queries()["op12_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n, buckets in ((0, 1), (1, 1), (5, 3), (20_000, 7)):
        keys = np.unique(r.integers(0, 1 << 48, n))
        of = perfect.bucket_of(keys, buckets)
        table = perfect.Table(buckets, [(b, *perfect.build(keys[of == b])) for b in range(buckets) if (of == b).any()])
        numbers = table.numbers(keys)
        assert sorted(numbers) == list(range(len(keys)))
        assert (table.keys[numbers] == keys).all()
        assert (table.numbers(np.setdiff1d(r.integers(0, 1 << 48, 500), keys)) == -1).all()


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


@pytest.fixture(scope="module")
def plain_aligner(library):
    plain = Tokenizer.from_file(alignment.A_FILE)
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    a_bytes = bpe.codec(alignment.A_FILE).v.tokens
    b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(model.id_to_piece(i) for i in range(model.get_piece_size()))]

    def one(text):
        if not text:
            return None
        a, b = plain.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        sa, sb = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
        if not b"".join(sa) == b"".join(sb) == (" " + text).encode():
            return None
        sa, sb = spans(sa), spans(sb)
        groups, links, i, j = [], [], 0, 0
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            i0, j0 = i, j
            while i < len(a) and sa[i][1] <= end:
                i += 1
            while j < len(b) and sb[j][1] <= end:
                j += 1
            groups.append((a[i0:i], b[j0:j]))
            links += [(a[x], b[y]) for x in range(i0, i) for y in range(j0, j) if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]]
        return a, b, groups, links

    return one


def plain_summary(one, docs):
    found = [one(t) for _, t in docs]
    counts = collections.Counter(p for x in found if x for p in set(x[3]))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (i, _), x in zip(docs, found, strict=True):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [(None, None), (1, ""), (2, " "), (3, "\n"), (4, "a▁b"), (5, "x "), (6, "  x  "), (7, "\x00"), (8, "word\n\n next\tone"), (8, "dup"), (8, "dup"), (9, "z" * 3000)]


@pytest.mark.parametrize("most", [4_000_000, 50])
def test_summaries_of_odd_texts(spark, plain_aligner, monkeypatch, most):
    """Both ways of looking counts up, texts in parts, ids that repeat."""
    docs = ODD + [(100 + k, t) for k, t in enumerate(odd_texts(600))] + [(9000, "the quick brown ab " * 70_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = alignment.summarize(df.selectExpr("*", "1 AS n_a", "'x' AS key"), most_pairs=most).select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_summary(plain_aligner, docs), key=key)


def test_alignment_query(spark, plain_aligner):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.queries()["op11_alignment"](spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(plain_summary(plain_aligner, docs))


def test_groups_and_pairs(spark, plain_aligner):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    want = {i: plain_aligner(t) for i, t in ODD}
    for r in alignment.align(df.where("doc_id <> 8")).collect():
        assert [(g["a"], g["b"]) for g in r["groups"]] == (want[r["id"]][2] if want[r["id"]] else [])
    counts = collections.Counter(p for _, t in ODD if (x := plain_aligner(t)) for p in set(x[3]))
    assert {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(df).collect()} == counts
    empty = df.limit(0)
    assert alignment.align(empty).count() == alignment.pair_counts(empty).count() == alignment.summarize(empty).count() == 0


def test_tasks_of_many_vectors(spark, plain_aligner, monkeypatch):
    monkeypatch.setattr(alignment, "_FAN", 2)
    docs = [(k, t) for k, t in enumerate(odd_texts(120, seed=9))]
    got = alignment.summarize(spark.createDataFrame(docs, "doc_id long, text string").repartition(9)).select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(plain_summary(plain_aligner, docs))
