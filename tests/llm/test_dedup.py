"""SimHash, decontamination and their edge cases against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import decontaminate, simhash

WORDS = [f"w{k}" for k in range(300)]


def texts(seed, n=60):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n)]
    for k in range(20):
        words = out[k].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return [*out, *out[:10], "", "", "  \t ", "one", "two words", None]


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius):
    label = dict(zip(ids, ids, strict=True))
    while True:
        new = {a: min(label[b] for b, g in zip(ids, fps, strict=True) if (f ^ g).bit_count() <= radius) for a, f in zip(ids, fps, strict=True)}
        if new == label:
            return label
        label = new


@given(st.text(max_size=80))
@settings(max_examples=100, deadline=None)
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text)[0] == plain_fingerprint(text)


def test_xxhash_is_sparks(spark):
    assert spark.sql("select xxhash64('a b é')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b é", 42)


def test_near_duplicates_against_brute_force(spark):
    rows = list(enumerate(texts(1)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component string, fp0 string")
    got = {r["id"]: (r["fp0"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], fps, 3)
    assert got == {i: (f, want[i]) for (i, _), f in zip(rows, fps, strict=True)}


@pytest.mark.parametrize(("radius", "segments"), [(3, 2), (3, 4), (5, 3), (7, 4)])
def test_links_join_all_near_pairs_in_linear_space(spark, radius, segments):
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    rows = [(f - 2**64 if f >= 2**63 else f, k) for k, f in enumerate(sorted(fps))]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, node long"), radius, segments).collect()
    ids, values = [k for _, k in rows], [f % 2**64 for f, _ in rows]
    parent = dict(zip(ids, ids, strict=True))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        assert (values[e["a"]] ^ values[e["b"]]).bit_count() <= radius
        a, b = find(e["a"]), find(e["b"])
        parent[max(a, b)] = min(a, b)
    assert {i: find(i) for i in ids} == plain_components(ids, values, radius)
    assert len(edges) < 80 * len(ids)


def test_a_hot_key_gives_a_forest():
    fps = np.arange(3000, dtype=np.uint64) & np.uint64(7)
    a, b = simhash.key_links(np.zeros(3000, dtype=np.int64), fps, np.arange(3000), np.zeros(3000, dtype=bool), 3)
    assert len(a) == len(b) == 2999


def test_keep_one_keeps_columns_and_null_ids(spark):
    docs = spark.createDataFrame([(3, "a b c d e", "p"), (1, "a b c d e", "q"), (2, "other words entirely here now", "r"), (None, "a b c d e", "s")], "doc_id long, text string, id string")
    kept = sorted((r["doc_id"] or -1, r["id"]) for r in simhash.keep_one(docs).collect())
    assert kept in ([(1, "q"), (2, "r")], [(-1, "s"), (1, "q"), (2, "r")])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.without_leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).count() == 1


def plain_matches(docs, items, width=5, threshold=0.8):
    out = set()
    for i, t in docs:
        w = decontaminate.words(t or "")
        for j, q in items:
            own = set(decontaminate.shingles(q or "", width))
            if own:
                n = len(next(iter(own)))
                have = set(zip(*(w[k:] for k in range(n)), strict=False))
                if len(own & have) >= threshold * len(own) - 1e-9:
                    out.add((i, j, len(own), len(own & have)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_containment_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 60])))) for k in range(40)] + [(40, ""), (41, None), (42, "Same Item"), (43, "same, item!")]
    docs = []
    for k in range(120):
        body = rng.choices(WORDS, k=rng.randint(0, 900))
        item = (items[rng.randrange(44)][1] or "").split()
        if item and rng.random() < 0.6 and len(item) > 10:
            item[rng.randrange(len(item))] = "edited"
        at = rng.randint(0, len(body))
        docs.append((k, " ".join([*body[:at], *item, *body[at:]]).upper()))
    docs += [(120, None), (121, ""), (122, docs[0][1]), (122, docs[0][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, shared long")
    q = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contained_items(d, q, block_bytes=block_bytes).collect()
    want = plain_matches(docs, items)
    assert {(r["id"], r["item_id"], r["item_shingles"], r["shared"]) for r in found} == want and want
    clean = {r["doc_id"] for r in decontaminate.without_leaks(d, q, block_bytes=block_bytes).collect()}
    assert clean == {i for i, _ in docs} - {m[0] for m in want}
