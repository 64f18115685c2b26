"""Sketches of shingle sets rule pairs out, and never similar ones."""

import numpy as np

from lectern.llm import overlap


def crowd(rng, texts, base=60, odd=12):
    """Sets that share three quarters of a base, the rest from a small pool: each shingle is in many of them."""
    common, pool = np.unique(rng.integers(0, 2**63, base, dtype=np.uint64)), np.unique(rng.integers(0, 2**63, 10 * odd, dtype=np.uint64))
    return [np.union1d(rng.choice(common, base - odd, replace=False), rng.choice(pool, odd, replace=False)) for _ in range(texts)]


def test_no_similar_pair_is_ruled_out():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 1500))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.union1d(a[rng.random(n) > rng.random() / 6], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 10)), dtype=np.uint64))
        fit = overlap.sketches_fit(np.array([len(a)]), overlap.sketch(a)[None, :], np.array([len(b)]), overlap.sketch(b)[None, :])
        assert fit[0] or not overlap.similar(len(np.intersect1d(a, b)), len(a), len(b))


def test_a_crowd_of_edited_copies_tells_few_pairs(spark):
    sets = crowd(np.random.default_rng(2), 120)
    near = sets[0].copy()
    near[0] ^= np.uint64(1)
    sets.append(np.sort(near))
    names = [f"sketch{k}" for k in range(overlap.SKETCH // 64)]
    rows = [(7, len(s), k, k, 0, *overlap.sketch(s).tolist()) for k, s in enumerate(sets)] + [(8, len(s), k, k, 0, *overlap.sketch(s).tolist()) for k, s in enumerate(sets[:6])]
    keyed = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("key", "n", "node", "component", "alone", *names)))
    told = {(r["a"], r["b"]) for r in overlap.prefix_pairs(keyed).collect()}
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if overlap.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert (0, len(sets) - 1) in similar
    assert similar <= told
    assert len(told) < 2 * len(sets)
