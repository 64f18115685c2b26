"""Components against a plain walk, by rounds alone and with the rest settled in one task."""

import random

import pytest

from lectern.operators import components


def plain(rows):
    label = {x: x for r in rows if None not in r for x in r}
    while (new := {x: min([label[x], *(label[b if a == x else a] for a, b in rows if x in (a, b) and None not in (a, b))]) for x in label}) != label:
        label = new
    return label


def graphs():
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 130)]
    hub = [(200, 201 + k) for k in range(40)] + [(300 + k, 340) for k in range(40)]
    loose = [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(45)]
    return chain + hub + loose + [(1, 1), (2, None), (None, 3), (131, 100), (101, 100), (102, 102)]


@pytest.mark.parametrize("rest", [0, 30, components._REST])
def test_components_by_rounds(spark, rest):
    rows = graphs()
    got = components.connected_components(spark.createDataFrame(rows, "a long, b long"), rest=rest).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == plain(rows)


def test_names_and_nothing(spark):
    rows = [("b", "a"), ("c", "b"), ("x", "x")]
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), rest=0).count() == 0


def test_links_shrink_round_by_round(spark, monkeypatch):
    """Records that share keys at random: before, every round went over as many links as there are nodes."""
    rng, counts = random.Random(6), []
    rows = [(i, rng.randrange(150)) for i in range(1500) for _ in range(4)]
    hubs = {k: min(i for i, other in rows if other == k) for k in range(150)}
    write = components.materialize

    def counted(df, label):
        out = write(df, label)
        counts.append((label, out.count()))
        return out

    monkeypatch.setattr(components, "materialize", counted)
    links = spark.createDataFrame([(i, hubs[k]) for i, k in rows], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(links, rest=0).collect()}
    assert got == dict.fromkeys({i for i, _ in rows}, 0)
    left = [n for label, n in counts if label == "cc-links"]
    assert left[0] == len(rows) and len(left) > 1
    assert all(b < a for a, b in zip(left, left[1:], strict=False))
    assert sum(left[2:]) < 1500
