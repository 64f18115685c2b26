"""Rules, repairs and matches of literature records on rows that tell the cases apart."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import records, text
from lectern.operators import matching
from lectern.operators import records as joins


def told(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("comment", "want"), [
    ("Accepted at NeurIPS 2024", ("NEURIPS", 1, 100)), ("to appear in the CVPR", ("CVPR", 2, 80)), ("Published at KDD", ("KDD", 3, 60)), ("accepted to ICML workshop", ("ICML Workshop", 4, 30)),
    ("A workshop paper", ("Workshop", 4, 30)), ("accepted at Nowhere", (None, 0, 0)), ("12 pages", (None, 0, 0)), (None, (None, 0, 0)),
])
def test_comment_venue(spark, comment, want):
    assert tuple(told(spark, records.comment_venue(F.col("c").cast("string")), c=comment)) == want


def test_decision_labels(spark):
    for label, want in (("ICLR 2025 Oral", "Oral"), ("ICML 2025 spotlightposter", "Spotlight"), ("x POSTER y", "Poster"), ("Accept", ""), ("temporal", "")):
        assert told(spark, records.decision_label(F.col("v")), v=label) == want


def test_repository_similarity(spark):
    def s(a, b):
        return told(spark, records.repository_similarity(F.col("a"), F.col("b")), a=a, b=b)

    assert s("Fast Nets", "fast-nets-code") == 1.0 and s("ab c", "ab-c") == 0.0 and s("deep models here", "models deep other") == 0.5 and s("", "x") == 0.0


def test_record_kinds(spark):
    def bogus(title, year, n, venue):
        return told(spark, records.is_bogus(F.col("t"), F.col("y"), F.col("n"), F.col("v")), t=title, y=year, n=n, v=venue)

    assert bogus("", 2020, 3, "ICML") and bogus("Introduction", 2020, 1, "ICML") and bogus("Open Source", 2020, 3, "Encyclopedia of things") and bogus("Open Source", 0, 3, "ICML")
    assert not bogus("Introduction", 2020, 2, "ICML") and not bogus("A long and usual title", 0, 0, "")

    def survey(title, abstract="", venue="", kind=""):
        return told(spark, records.is_survey(F.col("t"), F.col("a"), F.col("v"), F.col("k")), t=title, a=abstract, v=venue, k=kind)

    assert survey("A Survey of nets") and survey("Nets", "In this review we look") and survey("Nets", "", "ACM Computing Surveys") and survey("Nets", kind="Review")
    assert not survey("Review-based recommendation") and not survey("Surveillance video") and not survey("Nets", "we compare")
    assert told(spark, records.is_dataset(F.col("t"), F.col("a")), t="Pets: a benchmark", a="") and told(spark, records.is_dataset(F.col("t"), F.col("a")), t="Pets", a="We introduce a large new dataset of pets") and not told(spark, records.is_dataset(F.col("t"), F.col("a")), t="Pets", a="we use them")


def test_years(spark):
    for code, want in (("1901.01343", 2019), ("1913.01343", None), ("hep-th/9901001", 1999), ("cs.LG/0507123v2", 2005), ("x", None)):
        assert told(spark, records.preprint_year(F.col("c")), c=code) == want
    assert told(spark, records.proceedings_doi_year(F.col("d")), d="10.1109/CVPR.2019.00123") == 2019 and told(spark, records.proceedings_doi_year(F.col("d")), d="10.1145/1.2019.3") is None

    def fixed(year, pre="", listed=0, key="", venue="", doi=""):
        return told(spark, records.corrected_year(F.col("y"), F.col("p"), F.col("l"), F.col("k"), F.col("v"), F.col("d")), y=year, p=pre, l=listed, k=key, v=venue, d=doi)

    assert fixed(2018, listed=2019, key="conf/x") == 2019 and fixed(2018, listed=2020, key="conf/x") == 2018 and fixed(2018, listed=2019, key="journals/x") == 2018
    assert fixed(2018, venue="Conference on x", doi="10.1109/icde.2019.1") == 2019 and fixed(2018, venue="Letters", doi="10.1109/icde.2019.1") == 2018
    assert fixed(2018, pre="1801.00001", listed=2019, key="conf/x") == 2018 and fixed(2018, pre="1901.00001", listed=2019, key="conf/x") == 2019


def test_identity_repair(spark):
    columns = [F.col(c) for c in ("t", "a", "d", "x", "u", "b")]

    def repaired(**v):
        return told(spark, records.corrected_identity(*columns), **v)

    same = repaired(t="Deep nets for cats", a=["Ann Lee"], d="10.1/x", x="text", u="Deep nets for cats", b=["A. Lee"])
    assert same["changed"] == [] and same["doi"] == "10.1/x"
    other = repaired(t="Deep nets for cats", a=["Ann Lee"], d="10.1/x", x="text", u="Shallow trees about dogs", b=["Bo Yu", "C D"])
    assert other["changed"] == ["authors", "title"] and other["authors"] == ["Bo Yu", "C D"] and other["doi"] is None and other["abstract"] == "" and other["title"] == "Shallow trees about dogs"


def test_small_columns(spark):
    assert told(spark, records.tidy_latex(F.col("t")), t=r"On $\alpha$-nets and \emph{big} R\&D  {x}") == "On α-nets and big R&D x"
    assert told(spark, records.sanitized(F.col("t")), t="\u200b a\x00b\n ") == "ab"
    assert [told(spark, records.slug_is_valid(F.col("s")), s=s) for s in ("icml-2024", "themes", "a--b", "", "A")] == [True, False, False, False, False]
    assert [told(spark, records.tier_bucket(F.col("s")), s=s) for s in ("A+", "a", "Preprint", "7", "x")] == [1, 2, 3, 7, 99]
    assert told(spark, records.follow_score(F.col("a"), F.col("b"), ["ann  lee"], ["mit"]), a=["Ann Lee"], b=["x"]) == 100
    assert told(spark, records.follow_score(F.col("a"), F.col("b"), ["ann lee"], ["mit"]), a=["Bo"], b=["at MIT lab"]) == 50
    assert told(spark, text.titles_diverge(F.col("a"), F.col("b")), a="one two three", b="four five six") and not told(spark, records.titles_disagree(F.col("a"), F.col("b")), a="one two", b="one two three")
    assert told(spark, text.author_credit(F.col("a")), a=["Ann Lee", "Bo Yu", "C D"]) == "lee et al." and told(spark, text.bibtex_key(F.col("n"), F.lit(2020), F.lit("The big one")), n="Ann Lee") == "lee2020big"
    def suspect(title="x", venue="", doi="", cites=0, other=None, age=9, focus=False):
        r = told(spark, records.suspect_record(F.col("t"), F.col("v"), F.col("d"), F.col("c"), F.col("o").cast("int"), F.col("a"), F.col("f")), t=title, v=venue, d=doi, c=cites, o=other, a=age, f=focus)
        return r and (r["reasons"], r["action"])

    assert suspect("Keynote talk", cites=500) == (["event_title", "many_citations"], "dropped") and suspect("Keynote talk", cites=499) is None and suspect("Keynote talk", cites=500, focus=True)[1] == "flagged"
    assert suspect(doi="10.5281/zenodo.1", cites=400, other=10) == (["repository_record", "count_gap"], "dropped") and suspect(venue="Figshare", cites=800) == (["repository_record", "many_citations"], "dropped")
    assert suspect(cites=301, other=0) == (["count_gap"], "dropped") and suspect(cites=300, other=0) is None and suspect(cites=1500, other=300) is None
    assert suspect(cites=1000, age=1) == (["young_and_cited"], "flagged") and suspect(cites=1000, age=0) == (["young_and_cited"], "flagged") and suspect(cites=5000, age=2) is None


def test_ranked_matches(spark):
    hits = spark.createDataFrame([(1, 9, "n1", "title one"), (2, 8, None, "title one"), (3, 7, "n2", "title two"), (4, 99, None, "title two"), (5, 5, "n9", "title six"), (6, 4, None, "short")], "hit long, cites long, preprint string, title string")
    rows = spark.createDataFrame([(10, "n1", "title one"), (20, "n2", "title two"), (30, "n3", "title six"), (40, None, "short")], "row long, preprint string, title string")
    assert sorted(map(tuple, joins.match_ranked(hits, rows).collect())) == [(1, 10, "preprint"), (3, 20, "preprint"), (5, 30, "title")]


def test_title_merge_and_versions(spark):
    long = "a long title of five words"
    nodes = spark.createDataFrame([(1, long, 2001, False), (2, long.upper(), 2000, False), (3, long, 2009, False), (4, "short", 2000, False), (5, "short", 2000, False)], "id long, title string, year long, is_focus boolean")
    edges = spark.createDataFrame([(1, 4, "own"), (2, 4, "kept"), (1, 2, "loop"), (5, 1, "moved")], "src long, dst long, label string")
    kept, moved, merged = joins.merge_titles(nodes, edges)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4, 5] and sorted(map(tuple, merged.collect())) == [(1, 2)]
    assert sorted(map(tuple, moved.collect())) == [(2, 4, "kept"), (5, 2, "moved")]
    rows = [(1, "gnn", ["graph", "rag"], 2024, ["Ann Lee", "Bo Yu"], "2401.1", None), (2, "gnn", ["graph", "rag", "better"], 2025, ["A Lee", "B Yu", "C D"], None, "10.1/x"), (3, "gnn", ["other"], 2025, ["A Lee", "B Yu"], None, None), (4, "gnn", ["graph", "rag"], 2027, ["A Lee", "B Yu"], None, None), (5, "gnn", ["graph", "rag"], 2024, ["B Yu", "A Lee"], None, None)]
    papers = spark.createDataFrame(rows, "id long, prefix string, subtitle array<string>, year long, authors array<string>, preprint string, doi string")
    assert list(map(tuple, joins.versioned_pairs(papers).collect())) == [(1, 2)]


def test_suspects_and_inversions(spark):
    nodes = spark.createDataFrame([(1, 2010, 2010), (2, 2005, 2005), (3, 2006, 2006), (4, 2011, 2011)], "id long, year long, earliest long")
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 2), (4, 4)], "src long, dst long")
    found = joins.chronology_inversions(nodes, edges)
    assert list(map(tuple, found.collect())) == [(1, 2, 3, 5, True)]
    a = found.select("id", F.array(F.lit("x")).alias("reasons"), "dropped")
    b = spark.createDataFrame([(1, ["y"], False), (2, ["z"], False)], "id long, reasons array<string>, dropped boolean")
    assert sorted((r["id"], r["reasons"], r["dropped"]) for r in joins.merge_suspects(a, b).collect()) == [(1, ["x", "y"], True), (2, ["z"], False)]


def test_similar_sets_miss_no_pair(spark):
    rng = random.Random(6)
    sets = {k: frozenset(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))) for k in range(150)}
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()] + [(900, [])], "id long, items array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in matching.similar_sets(rows, 3, 5).collect()} == want and want


def test_typo_pairs_of_the_given_table(spark):
    from lectern.plans.catalogue import QUERIES

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    least = {}
    for k, name, kind in sorted(map(tuple, parts)):
        least.setdefault(f"{name} {('standart', 'standard', 'measured')[k % 3]} {kind} series", k)
    want, titles = set(), sorted(least.items())
    for i, (x, a) in enumerate(titles):
        for y, b in titles[i + 1 :]:
            u, v = x.split(" "), y.split(" ")
            differ = [(p, q) for p, q in zip(u, v, strict=False) if p != q]
            if len(u) == len(v) >= 4 and len(differ) == 1 and min(map(len, differ[0])) >= 7 and distance(*differ[0]) <= 2:
                want.add((min(a, b), max(a, b)))
    assert {tuple(r) for r in QUERIES["single_word_typos"].plan(spark, "/root/testdata/sf0.001").collect()} == want and want


def test_ordinals_are_dense_for_any_distribution(spark):
    from lectern.operators.ordinals import dense_ordinal, sorted_ordinal

    rows = [("a", 1)] * 50 + [("b", 10**12), ("a", -5), (None, 3), ("b", 2)]
    frame = spark.createDataFrame(rows, "g string, v long")
    got = sorted(((r["ordinal"], r["g"], r["v"]) for r in sorted_ordinal(frame, ["v", "g"]).collect()))
    assert [o for o, *_ in got] == list(range(len(rows))) and [v for _, _, v in got] == sorted(v for _, v in rows)
    assert sorted(r["ordinal"] for r in dense_ordinal(frame, "g", ["v"]).collect()) == list(range(len(rows)))


@pytest.mark.parametrize(("title", "abstract", "expected"), [
    ("Recent advances in nets", "", True), ("A comprehensive look at nets", "", True), ("Nets: challenges and opportunities", "", True), ("State-of-the-art in nets", "", True), ("Roadmap for nets", "", True), ("Nets: a perspective", "", True),
    ("Review-based recommendation", "", False), ("Survey-free nets", "", True), ("Nets", "We critically review the field.", True), ("Nets", "We review the related work.", False), ("Nets", "This paper reviews nets.", True), ("Nets", "We present a concise overview.", True), ("Multi-perspective nets", "", False),
])
def test_survey_patterns(spark, title, abstract, expected):
    nothing = F.lit(None).cast("string")
    assert told(spark, records.is_survey(F.col("t"), F.col("a"), nothing, nothing), t=title, a=abstract) is expected


def test_dataset_and_reference_works(spark):
    assert told(spark, records.is_dataset(F.col("t"), F.col("a")), t="Pets", a="Introducing a corpus of pets.") and told(spark, records.is_dataset(F.col("t"), F.col("a")), t="Pets", a="We built a large database.") and not told(spark, records.is_dataset(F.col("t"), F.col("a")), t="Pets", a="We build it. The corpus is old.")
    for venue in ("Definitions", "Glossary of things", "Qeios"):
        assert told(spark, records.is_bogus(F.lit("Open Source"), F.lit(2019), F.lit(3), F.col("v")), v=venue)
    assert not told(spark, records.is_bogus(F.lit("Open Source"), F.lit(2019), F.lit(3), F.col("v")), v="Handbook") and not told(spark, records.is_bogus(F.col("t"), F.lit(2019), F.lit(1), F.lit("")), t="X")
