"""The manifest's digests, proofs and climbs against a plain tree."""

import hashlib
import zlib

from lectern.llm import merkle, queries_manifest, registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, tree string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def plain_tree(nodes):
    """The root, and for each leaf its place and run of siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            path.append((at[k] % 3, nodes[at[k] // 3 * 3 : at[k] // 3 * 3 + 3]))
            at[k] //= 3
        nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    found = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        found.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, tops = plain_tree([subroot for _, subroot, _ in found])
    out = []
    for (own, subroot, paths), top in zip(found, tops, strict=True):
        for row, path in zip(own, paths, strict=True):
            bent = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                bent["text"] = row["text"].replace("\n", "")
            folded, proof = plain_leaf(bent), ""
            for k, run in path + top:
                folded, proof = digest(*run[:k], folded, *run[k + 1 :]), proof + "".join(run[:k] + run[k + 1 :])
            out.append((row["doc_id"], plain_leaf(row), subroot, root, digest(proof), folded, folded == root))
    return sorted(out, key=order)


def order(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def held(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(queries_manifest, "table", lambda *_: df)
    got = queries_manifest.op13_manifest(spark, "")
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=order), plain([r.asDict() for r in df.collect()]) if rows else []


def test_odd_rows(spark, monkeypatch):
    """Nulls everywhere, repeated rows and ids, sources of one row, more sources than a run, columns with clashing names."""
    rows = [(i, None if i % 7 == 0 else f"t\n{i}", None if i % 3 == 0 else "l", None if i % 5 == 0 else ("a" if i % 2 else f"s{i % 11}"), None, "q", i, "z") for i in range(400)]
    rows += [(None, "z\n", "e", "a", 1, "", 0, "")] * 3 + [(5, "dup\n", "e", "a", 1, "", 0, "")] * 4 + [(6, "x" * 300_000 + "\n", "e", "ü", 1, "", 0, "")]
    got, want = held(spark, monkeypatch, rows)
    assert got == want and {r[-1] for r in got} == {True, False}


def test_lone_and_empty(spark, monkeypatch):
    assert held(spark, monkeypatch, []) == ([], [])
    for rows in ([(1, "a\nb", "en", None, 3, "", 0, "")], [(2, "a\nb", "en", s, 3, "", 0, "") for s in ("a", "b")]):
        got, want = held(spark, monkeypatch, rows)
        assert got == want and len(got) == len(rows)


def test_many_sources(spark, monkeypatch):
    """The tree over the sources is higher than a pack, and a source too."""
    got, want = held(spark, monkeypatch, [(i, f"{i}\n", "e", f"s{i % 300}" if i % 2 else "hot", 1, "", 0, "") for i in range(1200)])
    assert got == want


def test_query_equals_its_sql(spark):
    assert differences(spark, registry.queries()["op13_manifest"], registry.oracle_sql()["op13_manifest"], SF) == []
