"""Citing sentences: names and markers of cited works, what cues govern, candidates of sentences and the relation of a pair."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import targets
from lectern.operators import relations

SWIN = ("Swin Transformer: Hierarchical Vision Transformer using Shifted Windows", ["Ze Liu", "Yutong Lin", "Yue Cao", "Han Hu"])
PAIR = "src int, dst int, found boolean, contexts array<string>, intents array<string>, influential boolean, citing_title string, citing_abstract string, citing_survey boolean, cited_title string, cited_authors array<string>, rank int"


def test_identity():
    names, surname, marker = targets.identity(*SWIN, ["Swin Transformer [28] is good.", "Others [3, 28] too."])
    assert names == ["swin transformer", "swin", "liu et al"] and surname == "liu" and marker == 28
    assert targets.identity("Pyramid Vision Transformer: a backbone", ["Li, Ann", "Bo Yu"], [])[0] == ["pyramid vision transformer", "pvt", "pyramid"]
    assert targets.identity("Semi-supervised things", ["Thomas N. Kipf", "Max Welling"], ["We use GCN (Kipf and Welling 2017) here.", "MLP (Kipf and Welling 2017)"])[0] == ["kipf et al", "kipf and welling", "kipf & welling", "gcn"]
    assert targets.identity("NeRF in the Wild: views", ["Ann Lee"], [])[0][1:3] == ["nerf works", "nerf-based works"] or "nerf works" in targets.identity("NeRF in the Wild: views", ["Ann Lee"], [])[0]
    assert "nerf" not in targets.identity("NeRF in the Wild: views", ["Ann Lee"], [])[0]
    assert targets.identity("Deep Learning: a thing", None, None) == ([], None, None) and targets.identity(None, [], []) == ([], None, None)
    assert targets.identity("X", ["Ann Leeds"], ["[17] Ann Leeds, Bo Yu, Things in Proc. 2020", "As in [4]."])[2] == 17
    assert targets.identity("X", ["Ann Leeds"], ["Both [54] and [39] do.", "All [54, 39, 22] of them.", "By [54] with [26]."])[2] == 54


@pytest.mark.parametrize(("text", "count", "numbers"), [
    ("none", 0, []), ("one [3]", 1, [3]), ("[3, 7-9]", 4, [3, 7, 8, 9]), ("[3]-[5]", 3, [3, 5]), ("(Smith et al., 2020; Lee, 2021)", 2, []), ("Smith et al. (2020) say", 1, []), ("[see 3]", 0, []),
])
def test_works_cited(text, count, numbers):
    assert targets.works_cited(text) == count and targets.markers(text) == numbers


def test_usable():
    assert targets.usable("We use the layers of others [3] in each of the blocks.") and not targets.usable("[17] Tri Dao, Daniel Fu, Stefano Ermon, and more of them in 2022.")
    assert not targets.usable("[19, 41].") and not targets.usable("Short one [3].") and not targets.usable("[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12] and [13].")


NAMES = (["swin transformer", "swin", "liu et al"], "liu", 28)


def cue(text, kind="builds", who=NAMES, abstract=False):
    return dict(zip(targets.SIGHTING.names, targets.sighting(text, *who, abstract), strict=True))[kind]


@pytest.mark.parametrize(("text", "strongly"), [
    ("As our architecture is adapted from Swin Transformer [28], we begin with it.", True),
    ("Our approach is inspired by [54] who proposed it and later extended it [54], with tools of [28].", False),
    ("A concurrent work [82] extends the Swin Transformer [28] to video.", False),
    ("We extend our pathway with the blocks of Swin Transformer [28].", False),
    ("We extend Swin Transformer [28] with more blocks.", True),
    ("Our method can readily extend to other backbones such as Swin Transformer [28].", False),
    ("Building upon the findings of Section 3, we go on with Swin [28].", False),
    ("Building upon this, we go on.", False),
    ("We build on the gates proposed by Swin Transformer [28].", True),
    ("We build on the gates of Swin Transformer [28] proposed by Wu et al. [9].", False),
    ("We use Light (Yao et al., 2025), a variant of Swin [28], as our model.", False),
    ("We train a variant of our own model in which Swin [28] is used.", False),
    ("This work generalizes mechanisms such as gates [3], Swin Transformer [28] and others [5].", True),
    ("We build on the good old way of doing things as in Liu et al. [28].", True),
])
def test_strong_cues(text, strongly):
    assert cue(text, "strongly") is strongly


def test_targets_of_sentences():
    assert [cue(t, "target") for t in ("Swin [28]", "Only [28].", "Others [3].", "No marker.", "CSWin is other.", "mip-Swin too.")] == ["named", "named", "other", "unmarked", "unmarked", "unmarked"]
    loose = (["net"], "liu", None)
    assert [cue(t, "target", loose) for t in ("One [3].", "Two [3, 4].", "Three [3, 4, 5].", "By Bronstein et al. (2017).", "By Liu et al. (2017).")] == ["single", "pair", "multi", "other", "single"]
    assert cue("Prior works [8, 28] that we build on.", "grouped") and not cue("Prior works [8, 28] and [28].", "grouped")
    assert cue("Swin-B is our modified Swin with gates.", "own_variant") and not cue("It is a modified Swin.", "own_variant")
    assert cue("While Swin [28] does, our own does not.", "while_cites") and not cue("While others do, we use Swin [28].", "while_cites")
    assert cue("We build on the library of Swin [28].", "usage") and cue("We build on a pre-trained language model [28].", "usage") and not cue("We build on Swin [28].", "usage")
    assert not cue("Unlike the recent Swin, we introduce the gate, based on others.", "builds", abstract=True)


def relation(spark, contexts=(), intents=(), influential=False, found=True, title="On gates", abstract=None, survey=None):
    df = spark.createDataFrame([(1, 2, found, list(contexts), list(intents), influential, title, abstract, survey, *SWIN, 0)], PAIR)
    r = relations.relations(df).first()
    return r["relation"], r["rule"], r["lineage"]


FILLER = "See Swin Transformer [28] for a history of the field and its methods."


@pytest.mark.parametrize(("sentence", "answer"), [
    ("We build upon Swin Transformer [28] with a gate in each of its layers.", ("builds_on", "phrase_build", "extends")),
    ("We follow Swin Transformer [28] and train with the same schedule as before.", ("uses_resource", "phrase_protocol", "baseline_only")),
    ("Following the protocol of Swin [28] our training outperforms all of the rest.", ("compares_with", "phrase_protocol", "baseline_only")),
    ("The table outperforming Swin Transformer [28] is shown for all of the sizes.", ("compares_with", "phrase_compare", "baseline_only")),
    ("We propose a strong baseline named Gate that we extend from Swin Transformer [28].", ("builds_on", "phrase_build", "extends")),
    ("We use the dataset of Swin Transformer [28] in each of the many tables.", ("uses_resource", "phrase_resource", "baseline_only")),
    ("Swin-T [28] 81.3 29.0 4.5 755.2 83.0 50.1 8.7", ("compares_with", "table_row", "baseline_only")),
    ("We extended the length of the outputs that Swin Transformer [28] gives us.", ("uses_resource", "phrase_usage", "baseline_only")),
    ("In contrast to Swin Transformer [28], ours has no windows and no shifts.", ("compares_with", "phrase_contrast", "contrasts")),
])
def test_candidates(spark, sentence, answer):
    assert relation(spark, [FILLER, sentence]) == answer


def test_order_of_rules(spark):
    assert relation(spark, found=False) == ("cites_unspecified", "pair_missing", None) and relation(spark) == ("cites_unspecified", "no_context", None)
    assert relation(spark, [FILLER]) == ("background", "context_no_cue", "baseline_only") and relation(spark, [FILLER], ["Result"])[1] == "intent_result"
    assert relation(spark, [FILLER], ["methodology"], True)[1] == "intent_methodology_influential" and relation(spark, [FILLER], ["methodology"])[1] == "context_no_cue"
    build, contrast = "We build upon Swin Transformer [28] in each of the layers here.", "Unlike Swin Transformer [28], ours has neither windows nor shifts."
    assert relation(spark, [contrast, build])[1] == "phrase_build" and relation(spark, [build], title="Gates: a survey")[1] == "citing_survey" and relation(spark, [build], survey=False, title="A survey of gates")[1] == "phrase_build"
    assert relation(spark, [FILLER], abstract="Nets. We build on the Swin Transformer to do more.")[1] == "abstract_build" and relation(spark, [contrast], abstract="We build on the Swin Transformer to do more.")[1] == "phrase_contrast"
    scope = "While Swin Transformer [28] shifts windows, our convolutional application of it shifts none."
    assert relation(spark, [scope])[1] == "phrase_build" and relation(spark, [scope, contrast])[:2] == ("compares_with", "phrase_contrast")


def test_odd_pairs(spark):
    rows = [(1, 2, None, None, None, None, None, None, None, None, None, 0)] * 2 + [(3, 4, True, ["", None, " "], [], None, None, None, None, None, None, 0)]
    assert sorted((r["src"], r["rule"]) for r in relations.relations(spark.createDataFrame(rows, PAIR)).collect()) == [(1, "pair_missing"), (3, "no_context")]
    assert relations.relations(spark.createDataFrame([], PAIR)).count() == 0


def test_lookup(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (5, 6), (7, 8), (9, 9)], "src int, dst int")
    evidence = spark.createDataFrame([(1, 2, ["s"], [], True), (1, 2, ["t"], [], True)], "src int, dst int, contexts array<string>, intents array<string>, influential boolean")
    lists = spark.createDataFrame([(1, "listed"), (5, "no_id"), (7, "unknown")], "src int, state string")
    assert {(r["src"], r["dst"]): (r["lookup"], r["found"]) for r in relations.looked_up(pairs, evidence, lists).collect()} == {(1, 2): ("listed", True), (1, 3): ("not_listed", False), (5, 6): ("no_id", False), (7, 8): ("citing_unknown", False), (9, 9): ("fetch_failed", False)}


def test_names_are_found_without_a_pattern_for_each(monkeypatch):
    import random

    import regex

    rng = random.Random(4)
    pieces = ["net7", "NET7", "Kiss", "KIſS", "Kiss", "İ", "ı", "-", " ", "x", "7", "[7]", "é", "ünet", "Ünet", "(", "_"]
    for _ in range(4000):
        text, name = "".join(rng.choice(pieces) for _ in range(9)), rng.choice(["net7", "kiss", "ünet", "istanbul", "net7net7", "i"])
        want = [m.span() for m in regex.finditer(rf"(?<![\p{{L}}\p{{N}}-]){regex.escape(targets.folded(name))}(?!\p{{L}})", text, regex.I)]
        assert list(targets._places(name, text)) == want, (name, text)

    def refused(*args, **kwargs):
        raise AssertionError("a pattern is compiled for a name")

    for made in ("compile", "finditer", "search"):
        monkeypatch.setattr(regex, made, refused)
    for k in range(50):
        contexts = [f"We build upon Net{k} [7] and add a gate to each of its layers in turn."]
        who = targets.identity(f"Net{k}: gates in layers", ["Ann Lee", "Bo Yu"], contexts)
        assert who[2] == 7 and targets.sighting(contexts[0], *who, False)[0] == "named"


def test_cues_are_read_only_where_a_part_of_them_stands(spark):
    from lectern.functions import cues
    from lectern.operators.relations import PARTS, _told

    said = ["We FOLLOW them in the settings.", "the same model as before", "Results are taken from [3]", "hyper-parameters directly from", "we use one similar to it", "We adopt the lr schedule of", "uses their set-up", "based on it, we study", "results", "Is Superior to", "compared it with", "State of the art", "improves over", "nothing", ""]
    rows = spark.createDataFrame([(t, t.lower()) for t in said], "s string, low string")
    for kind, patterns in (("protocol", cues.PROTOCOL), ("compare", cues.COMPARE)):
        got = rows.select(_told(F.col("s"), patterns, kind).alias("a"), _told(F.col("s"), patterns).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got) and sum(r["b"] for r in got) >= 3 and len(PARTS[kind]) > 5
