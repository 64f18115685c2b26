"""Contracts of built graphs: every check gives the rows that break it, one row a fault, as (graph_id, code, path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.storage import materialize

_RUN = 1_000  # places of a stored list that are compared in one group

# Fixed values of the contract.
RELATIONS = ("supersedes", "successor", "extends", "ablation", "baseline_only", "contrasts")
STRONG = ("supersedes", "successor", "extends")
METHODS = ("llm", "citation_heuristic", "intent_map", "context_pattern", "year_cite", "title_version", "foundational_allowlist", "s2_context_rule", "api_citation")
NAMESPACES = ("arxiv", "openreview", "acl_anthology", "cvf", "doi")
PAPER_ID = "^[0-9a-f]{40}$"
SHA256 = "^[0-9a-f]{64}$"
# End of the fixed values.


def _said(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) != ""


def _codes(*checks: tuple[str, Column]) -> Column:
    """The codes of the checks that are true; null counts as false."""
    return F.array_compact(F.array(*(F.when(broken, code) for code, broken in checks)))


def provenance_faults(provenance: Column) -> Column:
    """Codes of what a JSON text of (producer, evidence, classification) breaks. The objects are closed: no key may lack or
    be added. A language model's class needs its provider, model and prompt; null, no JSON or no object is one fault of shape.
    Values are compared as text, so a number where a text belongs passes as its digits."""
    parts = ("producer", "evidence", "classification")
    identity = ("provider", "model", "prompt_version")
    parsed = F.from_json(provenance, ", ".join(f"{p} map<string,string>" for p in parts))

    def closed(keys: Column, names: tuple[str, ...]) -> Column:
        return F.coalesce(F.array_sort(keys) == F.array(*map(F.lit, sorted(names))), F.lit(False))

    def judged(row: Column) -> Column:
        keys = {p: F.map_keys(row["parsed"][p]) for p in parts}

        def at(part: str, name: str) -> Column:
            return F.element_at(row["parsed"][part], F.lit(name))

        def lacks(part: str, *names: str) -> Column:
            return reduce(lambda a, b: a | b, (~_said(at(part, n)) for n in names))

        blank = reduce(lambda a, b: a | b, (at("classification", n).isNotNull() & ~_said(at("classification", n)) for n in identity))
        producer = lacks("producer", "name", "version")
        evidence = lacks("evidence", "source", "kind") | ~F.regexp(F.coalesce(at("evidence", "sha256"), F.lit("")), F.lit(SHA256))
        classed = row["parsed"]["classification"].isNotNull()
        method = at("classification", "method")
        found = _codes(
            ("provenance_fields", ~closed(row["keys"], parts)),
            ("provenance_producer", producer), ("provenance_producer_fields", ~producer & ~closed(keys["producer"], ("name", "version"))),
            ("provenance_evidence", evidence), ("provenance_evidence_fields", ~evidence & ~closed(keys["evidence"], ("source", "kind", "sha256"))),
            ("provenance_classification", ~classed),
            ("provenance_classification_fields", classed & ~closed(keys["classification"], ("method", *identity, "schema_version"))),
            ("classification_method", classed & ~F.coalesce(method.isin(*METHODS), F.lit(False))),
            ("classification_schema", classed & lacks("classification", "schema_version")),
            ("classification_identity", classed & blank),
            ("llm_identity", classed & (method == "llm") & lacks("classification", *identity)),
        )
        return F.when(row["keys"].isNull(), F.array(F.lit("provenance_shape"))).otherwise(found)

    # as the one element of an array the text is parsed once, however many checks read it
    once = F.array(F.struct(F.json_object_keys(provenance).alias("keys"), parsed.alias("parsed")))
    return F.element_at(F.transform(once, judged), 1)


def _at(kind: str, pos: str = "pos") -> Column:
    return F.concat(F.lit(f"{kind}["), F.col(pos).cast("string"), F.lit("]"))


def _whole(code: str, path: str = "root") -> list[Column]:
    return [F.col("graph_id"), F.lit(code).alias("code"), F.lit(path).alias("path")]


def _disorder(rows: DataFrame, key: tuple[str, ...], bad: DataFrame, code: str, path: str) -> DataFrame:
    """One fault a graph whose rows are not in order of ``key``. Rows are compared in runs of places, each with the first row of
    the next, so that a graph with a third of all rows is dealt over all tasks. Graphs with unusable keys (``bad``) are not judged."""
    run = F.floor(F.col("pos") / _RUN)
    runs = F.when((F.col("pos") % _RUN == 0) & (F.col("pos") > 0), F.array(run - 1, run)).otherwise(F.array(run))
    places = Window.partitionBy("graph_id", "_run").orderBy("pos")
    here = rows.select("graph_id", "pos", *key, F.explode(runs).alias("_run"))
    before = {f"_{k}": F.lag(k).over(places) for k in ("pos", *key)}
    wrong = here.withColumns(before).where((F.col("_pos") == F.col("pos") - 1) & (F.struct(*(F.col(f"_{k}").alias(k) for k in key)) > F.struct(*key)))
    return wrong.select("graph_id").distinct().join(bad.select("graph_id").distinct(), "graph_id", "left_anti").select(*_whole(code, path))


def artifact_faults(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Faults of graphs(graph_id, root) with nodes(graph_id, pos, id, is_focus, seed, aliases) and edges(graph_id, pos, src,
    dst, relation, rel, confidence, conf, rationale, provenance), ``pos`` being the place in the stored list from 0 and
    aliases an array of (namespace, source_id). A null or blank id is a fault of its own and takes part in no other; a
    graph without nodes must have no root. Each repeat of an id is told, of an edge each but the first, of a seed or alias
    once a graph. The root must be the focus of highest degree, smallest id, where there is any focus."""
    c = F.col
    faults: list[DataFrame] = []

    def told(rows: DataFrame, kind: str, *checks: tuple[str, Column]) -> None:
        faults.append(rows.select("graph_id", F.explode(_codes(*checks)).alias("code"), _at(kind).alias("path")))

    usable = nodes.where(_said(c("id")))
    # nodes and the ends of edges meet in one aggregation: _n nodes of an id, _nf of them focal, and _e ends
    own_ids = usable.select("graph_id", "id", F.lit(1).alias("_n"), F.coalesce("is_focus", F.lit(False)).cast("int").alias("_nf"), F.lit(0).alias("_e"))
    end_ids = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).where("id is not null").select("*", F.lit(0).alias("_n"), F.lit(0).alias("_nf"), F.lit(1).alias("_e"))
    met = materialize(own_ids.unionByName(end_ids).groupBy("graph_id", "id").agg(*(F.sum(x).alias(x) for x in ("_n", "_nf", "_e"))), "contract-ids")
    counts = met.where("_n > 0")
    told(nodes, "nodes", ("node_id", ~_said(c("id"))), ("focus_flag", c("is_focus").isNull()),
         ("focus_seed", c("is_focus") & ~F.regexp(F.coalesce("seed", F.lit("")), F.lit(PAPER_ID))), ("node_seed", ~F.coalesce("is_focus", F.lit(False)) & ~F.regexp("seed", F.lit(PAPER_ID))))
    faults.append(usable.join(counts.where("_n > 1"), ["graph_id", "id"], "left_semi").select("graph_id", F.lit("node_id_duplicate").alias("code"), _at("nodes").alias("path")))
    seeds = nodes.where(c("is_focus") & F.regexp("seed", F.lit(PAPER_ID))).groupBy("graph_id", "seed").count().where("count > 1")
    faults.append(seeds.select("graph_id", F.lit("focus_seed_duplicate").alias("code"), c("seed").alias("path")))

    alias = nodes.select("graph_id", "pos", F.explode("aliases").alias("a")).select("graph_id", "pos", c("a.namespace").alias("ns"), c("a.source_id").alias("sid"))
    fit = F.coalesce(c("ns").isin(*NAMESPACES) & _said(c("sid")) & (c("sid") == F.trim("sid")) & ((c("ns") != "doi") | (c("sid") == F.lower("sid"))), F.lit(False))
    told(alias.where(~fit), "nodes", ("node_alias_normalized", F.lit(True)))
    own = alias.where(fit).groupBy("graph_id", "ns", "sid", "pos").agg(F.count("*").alias("_n"))
    told(own.where("_n > 1"), "nodes", ("node_alias_duplicate", F.lit(True)))
    shared = own.groupBy("graph_id", "ns", "sid").agg(F.sum("_n").alias("_n")).where("_n > 1")
    faults.append(shared.select("graph_id", F.lit("node_alias_ambiguous").alias("code"), F.concat_ws(":", "ns", "sid").alias("path")))

    # edges that lack an end: it is null, or no node has its id
    missing = materialize(met.where("_n = 0").select("graph_id", "id"), "contract-missing")
    each = F.explode(F.array(F.struct(c("src").alias("id"), c("dst").alias("other")), F.struct(c("dst").alias("id"), c("src").alias("other")))).alias("x")
    loose_ends = edges.where("src is not null and dst is not null").select("graph_id", "pos", each).select("graph_id", "pos", "x.id", "x.other").join(missing, ["graph_id", "id"], "left_semi")
    null_ends = edges.where("src is null or dst is null").select("graph_id", "pos", c("src").alias("id"), c("dst").alias("other"))
    broken = materialize(loose_ends.dropDuplicates(["graph_id", "pos"]).select(*null_ends.columns).unionByName(null_ends), "contract-broken")
    told(broken, "edges", ("edge_endpoint", F.lit(True)))
    told(edges, "edges", ("edge_relation", ~F.coalesce(c("relation").isin(*RELATIONS), F.lit(False))), ("edge_relation_alias", ~c("rel").eqNullSafe(c("relation"))),
         ("edge_confidence", ~F.coalesce(c("confidence").between(0, 1), F.lit(False))), ("edge_confidence_alias", ~c("conf").eqNullSafe(c("confidence"))), ("edge_rationale", ~_said(c("rationale"))))
    faults.append(edges.select("graph_id", F.explode(provenance_faults(c("provenance"))).alias("code"), _at("edges").alias("path")))
    keyed = edges.where(_said(c("src")) & _said(c("dst")) & c("relation").isNotNull())
    same = Window.partitionBy("graph_id", "src", "dst", "relation").orderBy("pos")
    told(keyed.select("graph_id", "pos", F.row_number().over(same).alias("_k")).where("_k > 1"), "edges", ("edge_duplicate", F.lit(True)))

    faults.append(_disorder(nodes, ("id",), nodes.where(~_said(c("id"))), "node_order", "nodes"))
    loose = edges.where(~_said(c("src")) | ~_said(c("dst")) | c("relation").isNull())
    faults.append(_disorder(edges, ("src", "dst", "relation"), loose, "edge_order", "edges"))

    filled = nodes.select("graph_id").distinct().withColumn("_nodes", F.lit(True))
    less = broken.select("graph_id", F.explode(F.array("id", "other")).alias("id")).groupBy("graph_id", "id").agg(F.count("*").alias("_l"))
    ranked = counts.where("_nf > 0").join(less, ["graph_id", "id"], "left")
    best = ranked.groupBy("graph_id").agg(F.min(F.struct(F.coalesce("_l", F.lit(0)) - c("_e"), c("id"))).alias("_b")).select("graph_id", c("_b.id").alias("_best"))
    rooted = graphs.select("graph_id", "root").join(filled, "graph_id", "left").join(best, "graph_id", "left").join(counts.withColumnRenamed("id", "root"), ["graph_id", "root"], "left")
    some = F.coalesce("_nodes", F.lit(False))
    one, focal = F.coalesce("_n", F.lit(0)) == 1, F.coalesce("_nf", F.lit(0)) == 1
    codes = _codes(("root_missing", some & ~_said(c("root"))), ("root_resolution", some & _said(c("root")) & ~one), ("empty_root", ~some & c("root").isNotNull()),
                   ("root_focus", some & ~focal), ("root_deterministic", c("root").isNotNull() & (c("root") != c("_best"))))
    faults.append(rooted.select("graph_id", F.explode(codes).alias("code"), F.lit("root").alias("path")))
    return reduce(DataFrame.unionByName, faults)


def structural_faults(graphs: DataFrame, nodes: DataFrame, clusters: DataFrame, denied: DataFrame) -> DataFrame:
    """Faults of graphs(graph_id, min_year, is_theme) with nodes(graph_id, pos, id, is_focus, year, cluster), clusters
    (graph_id, id) and denied (id): no focus, which hides all others; a focus older than the limit, themes excepted; a
    denied focus; a cluster that the graph has not got, told of the first such node and of graphs with clusters only."""
    c = F.col
    focal = nodes.where("is_focus")
    none = graphs.join(focal.select("graph_id").distinct(), "graph_id", "left_anti")
    old = focal.join(graphs.where("not is_theme"), "graph_id").where("year < min_year").select("graph_id", F.lit("focus_too_old").alias("code"), _at("nodes").alias("path"))
    banned = focal.join(denied.select("id").distinct(), "id", "left_semi").select("graph_id", F.lit("focus_denied").alias("code"), _at("nodes").alias("path"))
    have = clusters.select("graph_id").distinct()
    known = clusters.select("graph_id", c("id").alias("cluster")).distinct()
    used = nodes.where("cluster is not null").groupBy("graph_id", "cluster").agg(F.min("pos").alias("pos"))
    loose = used.join(have, "graph_id", "left_semi").join(known, ["graph_id", "cluster"], "left_anti").join(none, "graph_id", "left_anti")
    first = loose.groupBy("graph_id").agg(F.min("pos").alias("pos")).select("graph_id", F.lit("cluster_dangling").alias("code"), _at("nodes").alias("path"))
    return reduce(DataFrame.unionByName, (none.select(*_whole("no_focus", "nodes")), old, banned, first))


def edge_label_faults(edges: DataFrame, labels: DataFrame, strong: tuple[str, ...] = STRONG) -> DataFrame:
    """Faults of labels(graph_id, pos, src, dst, relation, verdict) of edges(graph_id, src, dst, relation). A label with a
    null or another verdict than correct and wrong is invalid, one of no edge unknown, and neither counts further; a wrong
    verdict is a fault, a key labelled twice is told once, and so is a strong edge without a label."""
    c = F.col
    key = ["graph_id", "src", "dst", "relation"]
    path = F.concat("src", F.lit("->"), "dst", F.lit(":"), "relation").alias("path")
    have = edges.select(*key).dropna().distinct()
    fit = F.coalesce(c("src").isNotNull() & c("dst").isNotNull() & c("relation").isNotNull() & c("verdict").isin("correct", "wrong"), F.lit(False))
    invalid = labels.where(~fit).select("graph_id", F.lit("edge_label_invalid").alias("code"), _at("labels").alias("path"))
    met = labels.where(fit).join(have.withColumn("_e", F.lit(True)), key, "left")
    unknown = met.where("_e is null").select("graph_id", F.lit("edge_label_unknown").alias("code"), path)
    own = met.where("_e")
    wrong = own.where("verdict = 'wrong'").select("graph_id", F.lit("edge_wrong").alias("code"), path)
    counts = own.groupBy(*key).count()
    twice = counts.where("count > 1").select("graph_id", F.lit("edge_label_duplicate").alias("code"), path)
    bare = have.where(c("relation").isin(*strong)).join(counts, key, "left_anti").select("graph_id", F.lit("edge_unlabelled").alias("code"), path)
    return reduce(DataFrame.unionByName, (invalid, unknown, wrong, twice, bare))
