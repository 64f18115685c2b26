"""Structural differences against a plain recursive walk."""

import json
import random

from lectern.operators.structure import json_diff


def kind_of(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else {dict: "object", list: "array", str: "string"}[type(v)]


def walk(e, a, at="", skip=lambda p: False):
    if kind_of(e) != kind_of(a):
        return [(at, "type_mismatch")]
    if not isinstance(e, (dict, list)):
        return [] if e == a else [(at, "value_mismatch")]
    out = []
    if isinstance(e, list):
        out = [(at, "length_mismatch")] if len(e) != len(a) else []
        e, a = ({str(k): v for k, v in enumerate(x)} for x in (e, a))
    for name in e.keys() | a.keys():
        below = f"{at}/{name.replace('~', '~0').replace('/', '~1')}"
        if skip(below):
            continue
        out += [(below, "missing_in_expected")] if name not in e else [(below, "missing_in_actual")] if name not in a else walk(e[name], a[name], below, skip)
    return out


def made(r, depth=0):
    if depth < 4 and r.random() < 0.6:
        if r.random() < 0.5:
            return [made(r, depth + 1) for _ in range(r.randrange(4))]
        return {r.choice(["a", "b", "c/d", "e~f", "g"]): made(r, depth + 1) for _ in range(r.randrange(4))}
    return r.choice([None, True, False, 0, 1, 1.5, -3, "x", "y", ""])


def changed(r, v):
    if r.random() < 0.15:
        return made(r, 3)
    if isinstance(v, list):
        return [changed(r, x) for x in v][: len(v) - (r.random() < 0.1)]
    if isinstance(v, dict):
        return {k: changed(r, x) for k, x in v.items() if r.random() > 0.1}
    return v


def got(spark, docs, ignore=None):
    df = spark.createDataFrame([(k, None if e is None else json.dumps(e), None if a is None else json.dumps(a), "x") for k, (e, a) in enumerate(docs)], "id int, e string, a string, pointer string")
    return json_diff(df, "id", "e", "a", ignore).collect()


def test_random_documents(spark):
    r = random.Random(6)
    docs = [(d, changed(r, d)) for d in (made(r) for _ in range(150))]
    rows = got(spark, docs)
    assert sorted((x["doc"], x["pointer"], x["kind"]) for x in rows) == sorted((k, *d) for k, (e, a) in enumerate(docs) for d in walk(e, a))
    assert {x["kind"] for x in rows} == {"type_mismatch", "length_mismatch", "missing_in_expected", "missing_in_actual", "value_mismatch"}


def test_values_and_ignored_pointers(spark):
    e = {"n": 1, "at": "2020", "list": [{"id": 1, "when": 5}, {"id": 2, "when": 6}], "x": {"a": 1}}
    a = {"n": 1.0, "at": "2021", "list": [{"id": 1, "when": 7}, {"id": 3, "when": 8}], "x": {"b": 2}}
    rows = {(x["pointer"], x["kind"], x["expected"], x["actual"]) for x in got(spark, [(e, a)], ["/at", "/list/*/when", "/x"])}
    assert rows == {("/list/1/id", "value_mismatch", "2", "3")}
    assert {(x["doc"], x["pointer"], x["kind"]) for x in got(spark, [(None, None), (None, 1), ([], {}), ([1, 2], [1])])} == {(1, "", "type_mismatch"), (2, "", "type_mismatch"), (3, "", "length_mismatch"), (3, "/1", "missing_in_actual")}
    assert got(spark, []) == []
