"""Contracts of graphs, labels and snapshots over tables in which faults of every kind are planted, and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.identity import stable_id
from lectern.operators import contracts, snapshots
from lectern.plans.queries_io import _place
from lectern.plans.registry import query
from lectern.plans.storage import materialize
from lectern.plans.views import EDGES_SQL, edges, nodes, table
from lectern.sources import published

_SHA = "0" * 64
_P, _E = '"producer":{"name":"builder","version":"2"}', f'"evidence":{{"source":"s2","kind":"context","sha256":"{_SHA}"}}'


def _class(method: str = "api_citation", provider: str = "null", more: str = "") -> str:
    return f'"classification":{{"method":"{method}","provider":{provider},"model":null,"prompt_version":null,"schema_version":"1"{more}}}'


#: What the edges of every twelfth end say of where they come from; the last is sound.
PROVENANCE = [
    None, "no json", "[1]", f"{{{_P},{_E}}}", f'{{{_P},{_E},{_class()},"x":1}}', f"{{{_P},{_E},{_class('llm', chr(34) + 'p' + chr(34))}}}", f"{{{_P},{_E},{_class('guess')}}}", f"{{{_P},{_E},{_class(provider=chr(34) + ' ' + chr(34))}}}",
    f"{{{_P},{_E.replace(_SHA, 'ab')},{_class()}}}", f'{{{_P[:-1]},"by":"me"}},{_E},{_class()}}}', f'{{"producer":{{"name":""}},{_E[:-1]},"page":1}},{_class(more=chr(44) + chr(34) + "y" + chr(34) + ":1").replace(chr(34) + "1" + chr(34) + ",", chr(34) + chr(34) + ",")}}}', f"{{{_P},{_E},{_class()}}}",
]
_SAID = "[" + ", ".join("NULL" if p is None else f"'{p}'" for p in PROVENANCE) + "]"


def _text(column: Column) -> Column:
    return F.lpad(column.cast("string"), 12, "0")


def _copies(planted: Column) -> Column:
    return F.explode(F.when(planted, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))


def _artifact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = F.col
    sha = lambda x: F.substring(F.sha2(x.cast("string").cast("binary"), 256), 1, 40)
    turned = lambda x: F.when(c("graph_id") % 13 == 0, -c(x)).otherwise(c(x))
    rows = nodes(spark, sf_dir).select("graph_id", c("id").alias("k"), "rn", _copies(c("id") % 89 == 0).alias("copy"))

    def alias(namespace: str, source_id: Column) -> Column:
        return F.struct(F.lit(namespace).alias("namespace"), source_id.alias("source_id"))

    own = alias("doi", F.concat(F.lit("10.1/"), "k"))
    more = [(c("k") % 37 == 0, own), ((c("graph_id") % 11 == 0) & (c("k") % 5 == 0), alias("arxiv", F.lit("shared"))), (c("k") % 107 == 0, alias("doi", F.lit("10.1/X")))]
    n = rows.select(
        "graph_id", "k", "rn", (F.row_number().over(Window.partitionBy("graph_id").orderBy(turned("k"), "copy")) - 1).alias("pos"), F.when(c("k") % 97 != 0, _text(c("k"))).alias("id"), F.when(c("k") % 101 != 0, c("rn") <= 2).alias("is_focus"),
        F.when((c("rn") <= 2) & (c("k") % 31 == 0), "x").when((c("rn") <= 2) & (c("graph_id") % 29 == 0), sha(c("graph_id"))).when(c("rn") <= 2, sha(c("k"))).when(c("k") % 103 == 0, "y").alias("seed"),
        F.array_compact(F.array(own, *(F.when(p, a) for p, a in more))).alias("aliases"),
    )
    focal = F.min(F.when(c("rn") <= 2, _text(c("k"))))
    graphs = n.groupBy("graph_id").agg(focal.alias("_f"), F.max(_text(c("k"))).alias("_m"))
    graphs = graphs.select("graph_id", F.when(c("graph_id") % 19 == 0, "?").when(c("graph_id") % 23 == 0, c("_m")).when(c("graph_id") % 17 != 0, c("_f")).alias("root"))
    links = edges(spark, sf_dir).select("graph_id", c("src").alias("s"), c("dst").alias("d"), c("relation").alias("r"), _copies(c("src") % 71 == 0).alias("copy"))
    conf = F.when(c("d") % 47 == 0, 1.5).when(c("d") % 53 != 0, 0.8)
    e = links.select(
        "graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy(turned("s"), "d", "copy")) - 1).alias("pos"), _text(c("s")).alias("src"), F.when(c("d") % 67 == 0, "gone").otherwise(_text(c("d"))).alias("dst"),
        F.when(c("d") % 73 == 0, "cites").otherwise(c("r")).alias("relation"), F.when(c("d") % 43 == 0, "other").when(c("d") % 73 == 0, "cites").otherwise(c("r")).alias("rel"), conf.alias("confidence"), F.when(c("s") % 59 == 0, 0.5).otherwise(conf).alias("conf"),
        F.when(c("d") % 61 == 0, " ").otherwise("cites").alias("rationale"), F.element_at(F.array(*(F.lit(p).cast("string") for p in PROVENANCE)), F.when(c("s") % 3 == 0, (c("d") % 12 + 1).cast("int")).otherwise(12)).alias("provenance"),
    )
    return graphs, n.drop("k", "rn"), e


_CODES = "SELECT graph_id, unnest(list_filter([{}], lambda x: x IS NOT NULL)) AS code, {} AS path FROM {}"


def _told(kind: str, rows: str, **checks: str) -> str:
    return _CODES.format(", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in checks.items()), f"'{kind}[' || pos || ']'", rows)


_EMPTY = "trim(coalesce({}, '')) = ''"
_ARTIFACT_SQL = f"""WITH {EDGES_SQL},
n AS (SELECT graph_id, id AS k, rn, row_number() OVER (PARTITION BY graph_id ORDER BY CASE WHEN graph_id % 13 = 0 THEN -id ELSE id END, copy) - 1 AS pos, CASE WHEN id % 97 <> 0 THEN lpad(CAST(id AS VARCHAR), 12, '0') END AS nid, CASE WHEN id % 101 <> 0 THEN rn <= 2 END AS is_focus,
  CASE WHEN rn <= 2 AND id % 31 = 0 THEN 'x' WHEN rn <= 2 AND graph_id % 29 = 0 THEN left(sha256(CAST(graph_id AS VARCHAR)), 40) WHEN rn <= 2 THEN left(sha256(CAST(id AS VARCHAR)), 40) WHEN id % 103 = 0 THEN 'y' END AS seed FROM (SELECT *, unnest(CASE WHEN id % 89 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM o)),
al AS (SELECT graph_id, pos, unnest([['doi', '10.1/' || k], CASE WHEN k % 37 = 0 THEN ['doi', '10.1/' || k] END, CASE WHEN graph_id % 11 = 0 AND k % 5 = 0 THEN ['arxiv', 'shared'] END, CASE WHEN k % 107 = 0 THEN ['doi', '10.1/X'] END]) AS a FROM n),
e AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY CASE WHEN graph_id % 13 = 0 THEN -src ELSE src END, dst, copy) - 1 AS pos, lpad(CAST(src AS VARCHAR), 12, '0') AS src, CASE WHEN dst % 67 = 0 THEN 'gone' ELSE lpad(CAST(dst AS VARCHAR), 12, '0') END AS dst,
  CASE WHEN dst % 73 = 0 THEN 'cites' ELSE relation END AS relation, CASE WHEN dst % 43 = 0 THEN 'other' WHEN dst % 73 = 0 THEN 'cites' ELSE relation END AS rel, CASE WHEN dst % 47 = 0 THEN 1.5 WHEN dst % 53 <> 0 THEN 0.8 END AS confidence, CASE WHEN src % 59 = 0 THEN 0.5 WHEN dst % 47 = 0 THEN 1.5 WHEN dst % 53 <> 0 THEN 0.8 END AS conf,
  CASE WHEN dst % 61 = 0 THEN ' ' ELSE 'cites' END AS rationale, CASE WHEN src % 3 = 0 THEN CAST(dst % 12 + 1 AS INTEGER) ELSE 12 END AS v FROM (SELECT *, unnest(CASE WHEN src % 71 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM edges)),
raw AS (SELECT v, CASE WHEN json_valid(t) THEN t END AS p FROM (SELECT unnest(range(1, 13)) AS v, unnest({_SAID}) AS t)),
px AS (SELECT v, json_type(p) = 'OBJECT' AS whole, list_sort(json_keys(p)) AS k0, list_sort(json_keys(p, '$.producer')) AS kp, list_sort(json_keys(p, '$.evidence')) AS ke, list_sort(json_keys(p, '$.classification')) AS kc, json_type(p, '$.classification') = 'OBJECT' AS sorted,
  p->>'$.classification.method' AS method, p->>'$.classification.schema_version' AS schema, [p->>'$.classification.provider', p->>'$.classification.model', p->>'$.classification.prompt_version'] AS who,
  {_EMPTY.format("p->>'$.producer.name'")} OR {_EMPTY.format("p->>'$.producer.version'")} AS bp, {_EMPTY.format("p->>'$.evidence.source'")} OR {_EMPTY.format("p->>'$.evidence.kind'")} OR NOT regexp_full_match(coalesce(p->>'$.evidence.sha256', ''), '[0-9a-f]{{64}}') AS be FROM raw),
pv AS (SELECT v, CASE WHEN NOT coalesce(whole, false) THEN ['provenance_shape'] ELSE list_filter([CASE WHEN k0 <> ['classification', 'evidence', 'producer'] THEN 'provenance_fields' END, CASE WHEN bp THEN 'provenance_producer' WHEN kp <> ['name', 'version'] THEN 'provenance_producer_fields' END,
  CASE WHEN be THEN 'provenance_evidence' WHEN ke <> ['kind', 'sha256', 'source'] THEN 'provenance_evidence_fields' END, CASE WHEN NOT coalesce(sorted, false) THEN 'provenance_classification' END, CASE WHEN sorted AND kc <> ['method', 'model', 'prompt_version', 'provider', 'schema_version'] THEN 'provenance_classification_fields' END,
  CASE WHEN sorted AND coalesce(method, '') NOT IN {contracts.METHODS} THEN 'classification_method' END, CASE WHEN sorted AND {_EMPTY.format("schema")} THEN 'classification_schema' END, CASE WHEN sorted AND len(list_filter(who, lambda x: trim(x) = '')) > 0 THEN 'classification_identity' END,
  CASE WHEN sorted AND method = 'llm' AND len(list_filter(who, lambda x: {_EMPTY.format("x")})) > 0 THEN 'llm_identity' END], lambda x: x IS NOT NULL) END AS codes FROM px),
cn AS (SELECT graph_id, nid, count(*) AS c, bool_or(coalesce(is_focus, false)) AS focal, count(*) FILTER (WHERE is_focus) AS nf FROM n WHERE nid IS NOT NULL GROUP BY ALL),
ei AS (SELECT e.*, a.nid IS NOT NULL AND b.nid IS NOT NULL AS inside FROM e LEFT JOIN cn a ON a.graph_id = e.graph_id AND a.nid = e.src LEFT JOIN cn b ON b.graph_id = e.graph_id AND b.nid = e.dst),
dg AS (SELECT graph_id, nid, count(*) AS d FROM (SELECT graph_id, unnest([src, dst]) AS nid FROM ei WHERE inside) GROUP BY ALL),
bs AS (SELECT graph_id, nid AS best FROM cn LEFT JOIN dg USING (graph_id, nid) WHERE focal QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY coalesce(d, 0) DESC, nid) = 1),
gr AS (SELECT graph_id, CASE WHEN graph_id % 19 = 0 THEN '?' WHEN graph_id % 23 = 0 THEN max(lpad(CAST(k AS VARCHAR), 12, '0')) WHEN graph_id % 17 <> 0 THEN min(lpad(CAST(k AS VARCHAR), 12, '0')) FILTER (WHERE rn <= 2) END AS root FROM n GROUP BY graph_id),
rt AS (SELECT gr.*, best, c, nf FROM gr LEFT JOIN bs USING (graph_id) LEFT JOIN cn ON cn.graph_id = gr.graph_id AND nid = root),
fit AS (SELECT graph_id, pos, a[1] AS ns, a[2] AS sid, a[1] <> 'doi' OR a[2] = lower(a[2]) AS ok FROM al WHERE a IS NOT NULL),
own AS (SELECT graph_id, ns, sid, pos, count(*) AS c FROM fit WHERE ok GROUP BY ALL)
{_told("nodes", "n", node_id="nid IS NULL", focus_flag="is_focus IS NULL", focus_seed="is_focus AND NOT regexp_full_match(coalesce(seed, ''), '[0-9a-f]{40}')", node_seed="NOT coalesce(is_focus, false) AND NOT regexp_full_match(seed, '[0-9a-f]{40}')")}
UNION ALL SELECT n.graph_id, 'node_id_duplicate', 'nodes[' || pos || ']' FROM n JOIN cn USING (graph_id, nid) WHERE c > 1
UNION ALL SELECT graph_id, 'focus_seed_duplicate', seed FROM n WHERE is_focus AND length(seed) = 40 GROUP BY ALL HAVING count(*) > 1
UNION ALL {_told("nodes", "fit", node_alias_normalized="NOT ok")}
UNION ALL {_told("nodes", "own", node_alias_duplicate="c > 1")}
UNION ALL SELECT graph_id, 'node_alias_ambiguous', ns || ':' || sid FROM own GROUP BY graph_id, ns, sid HAVING sum(c) > 1
UNION ALL {_told("edges", "ei", edge_endpoint="NOT inside", edge_relation=f"relation NOT IN {contracts.RELATIONS}", edge_relation_alias="rel <> relation", edge_confidence="NOT coalesce(confidence BETWEEN 0 AND 1, false)", edge_confidence_alias="conf IS DISTINCT FROM confidence", edge_rationale="trim(rationale) = ''")}
UNION ALL SELECT graph_id, unnest(codes), 'edges[' || pos || ']' FROM e JOIN pv USING (v)
UNION ALL SELECT graph_id, 'edge_duplicate', 'edges[' || pos || ']' FROM (SELECT *, min(pos) OVER (PARTITION BY graph_id, src, dst, relation) AS p0 FROM e) WHERE pos > p0
UNION ALL SELECT DISTINCT graph_id, 'node_order', 'nodes' FROM (SELECT graph_id, nid, lag(nid) OVER (PARTITION BY graph_id ORDER BY pos) AS before FROM n) WHERE before > nid AND graph_id NOT IN (SELECT graph_id FROM n WHERE nid IS NULL)
UNION ALL SELECT DISTINCT graph_id, 'edge_order', 'edges' FROM (SELECT graph_id, [src, dst, relation] AS r, lag([src, dst, relation]) OVER (PARTITION BY graph_id ORDER BY pos) AS before FROM e) WHERE before > r
UNION ALL {_CODES.format("CASE WHEN root IS NULL THEN 'root_missing' END, CASE WHEN root IS NOT NULL AND coalesce(c, 0) <> 1 THEN 'root_resolution' END, CASE WHEN coalesce(nf, 0) <> 1 THEN 'root_focus' END, CASE WHEN root <> best THEN 'root_deterministic' END", "'root'", "rt")}"""


@query("V01 V02", _ARTIFACT_SQL)
def artifact_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a stored graph; ids, seeds, aliases, order, roots, edges and provenance have planted faults."""
    graphs, n, e = _artifact(spark, sf_dir)
    return contracts.artifact_faults(graphs, materialize(n, "artifact-nodes"), materialize(e, "artifact-edges"))


@query("V06", f"""WITH {EDGES_SQL}, n AS (SELECT graph_id, id, rn - 1 AS pos, graph_id % 9 <> 0 AND rn <= 2 AS focus, yr, CASE WHEN id % 10 = 0 THEN 'z' ELSE 'c' || id % 3 END AS cluster FROM o),
none AS (SELECT graph_id FROM n GROUP BY graph_id HAVING NOT bool_or(focus))
SELECT graph_id, 'no_focus' AS code, 'nodes' AS path FROM none
UNION ALL SELECT graph_id, 'focus_too_old', 'nodes[' || pos || ']' FROM n WHERE focus AND yr < 1994 + graph_id % 3 AND graph_id % 4 <> 0
UNION ALL SELECT graph_id, 'focus_denied', 'nodes[' || pos || ']' FROM n WHERE focus AND id % 50 = 0
UNION ALL SELECT graph_id, 'cluster_dangling', 'nodes[' || min(pos) || ']' FROM n WHERE graph_id % 5 <> 0 AND (cluster = 'z' OR (cluster = 'c2' AND graph_id % 7 = 0)) AND graph_id NOT IN (SELECT graph_id FROM none) GROUP BY graph_id""")
def structural_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs without focus, with focus papers that are too old or denied, and with clusters that they have not got."""
    c = F.col
    n = nodes(spark, sf_dir).select("graph_id", "id", (c("rn") - 1).alias("pos"), ((c("graph_id") % 9 != 0) & (c("rn") <= 2)).alias("is_focus"), c("yr").alias("year"), F.when(c("id") % 10 == 0, "z").otherwise(F.concat(F.lit("c"), c("id") % 3)).alias("cluster"))
    graphs = n.select("graph_id").distinct().select("graph_id", (1994 + c("graph_id") % 3).alias("min_year"), (c("graph_id") % 4 == 0).alias("is_theme"))
    clusters = graphs.where("graph_id % 5 <> 0").select("graph_id", F.explode(F.when(c("graph_id") % 7 == 0, F.array(F.lit("c0"), F.lit("c1"))).otherwise(F.array(F.lit("c0"), F.lit("c1"), F.lit("c2")))).alias("id"))
    return contracts.structural_faults(graphs, n, clusters, n.where("id % 50 = 0").select("id"))


@query("V07", f"""WITH {EDGES_SQL}, e AS (SELECT graph_id, src, dst, relation FROM edges),
l AS (SELECT graph_id, dst AS pos, src, dst, CASE WHEN src % 37 = 0 THEN 'ablation' ELSE relation END AS relation, CASE WHEN dst % 23 = 0 THEN 'wrong' WHEN dst % 29 = 0 THEN 'maybe' WHEN dst % 41 <> 0 THEN 'correct' END AS verdict, unnest(CASE WHEN src % 31 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM e WHERE (relation IN {contracts.STRONG} OR src % 4 = 0) AND dst % 19 <> 0),
m AS (SELECT l.*, e.src IS NOT NULL AS have, l.src || '->' || l.dst || ':' || l.relation AS path FROM l LEFT JOIN e ON e.graph_id = l.graph_id AND e.src = l.src AND e.dst = l.dst AND e.relation = l.relation WHERE verdict IN ('correct', 'wrong'))
SELECT graph_id, 'edge_label_invalid' AS code, 'labels[' || pos || ']' AS path FROM l WHERE coalesce(verdict, '') NOT IN ('correct', 'wrong')
UNION ALL SELECT graph_id, 'edge_label_unknown', path FROM m WHERE NOT have
UNION ALL SELECT graph_id, 'edge_wrong', path FROM m WHERE have AND verdict = 'wrong'
UNION ALL SELECT graph_id, 'edge_label_duplicate', path FROM m WHERE have GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT graph_id, 'edge_unlabelled', src || '->' || dst || ':' || relation FROM e WHERE relation IN {contracts.STRONG} AND (graph_id, src || '->' || dst || ':' || relation) NOT IN (SELECT graph_id, path FROM m WHERE have)""")
def edge_label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's labels of edges: some lack, say nothing known, name other edges, are told twice or say wrong."""
    c = F.col
    e = edges(spark, sf_dir).select("graph_id", "src", "dst", "relation")
    verdict = F.when(c("dst") % 23 == 0, "wrong").when(c("dst") % 29 == 0, "maybe").when(c("dst") % 41 != 0, "correct")
    some = e.where((c("relation").isin(*contracts.STRONG) | (c("src") % 4 == 0)) & (c("dst") % 19 != 0))
    labels = some.select("graph_id", c("dst").alias("pos"), "src", "dst", F.when(c("src") % 37 == 0, "ablation").otherwise(c("relation")).alias("relation"), verdict.alias("verdict"), _copies(c("src") % 31 == 0).alias("copy"))
    return contracts.edge_label_faults(e, labels.drop("copy"))


_CELLS = " || ".join(f"coalesce(strlen(CAST({n} AS VARCHAR)) || ':' || {n}, '-')" for n in ("doc_id", "lang", "text"))


@query("V09 G18", f"""WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, sha256({_CELLS}) AS d FROM documents WHERE source IS NOT NULL),
a AS (SELECT source, k // 1000 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d, count(*) AS n FROM r GROUP BY source, k // 1000),
b AS (SELECT source, k // 1000 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d, sum(n) AS n FROM a GROUP BY source, k // 1000)
SELECT source, sha256(string_agg(d, '' ORDER BY k)) AS digest, CAST(sum(n) AS BIGINT) AS n_rows FROM b GROUP BY source""")
def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in order as one digest, computed run by run."""
    return snapshots.ordered_digests(table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "text"), "source", ["doc_id"], ["doc_id", "lang", "text"])


_TITLE = "CASE WHEN doc_id % 97 = 0 THEN ' ' WHEN doc_id % 53 = 0 THEN 'same' ELSE 'T' || doc_id END"


@query("V09", f"""WITH x AS (SELECT *, source || '-' || lang AS snapshot, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS sid, doc_id % 43 = 0 AS twice FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
r AS (SELECT snapshot, lang, doc_id, text, CASE WHEN doc_id % 41 = 0 THEN 'no id' ELSE sid END AS sid, {_TITLE} AS title, CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'Withdrawn' WHEN doc_id % 2 = 0 THEN ' Oral ' ELSE 'poster' END AS decision,
  CASE WHEN doc_id % 47 = 0 THEN [] WHEN doc_id % 59 = 0 THEN ['Lee, Ann'] WHEN doc_id % 61 = 0 THEN ['A', ' '] ELSE ['Ann Lee', 'Bo'] END AS authors, unnest(CASE WHEN twice THEN [0, 1] ELSE [0] END) AS copy FROM x),
f AS (SELECT snapshot, CASE WHEN sid = 'no id' THEN ['row_identity'] ELSE [] END || CASE WHEN trim(title) = '' THEN ['title'] ELSE [] END || CASE WHEN length(coalesce(text, '')) > 100000 THEN ['abstract'] ELSE [] END || CASE WHEN decision = '' THEN ['decision_label'] ELSE [] END
  || CASE WHEN authors = [] THEN ['authors'] ELSE [] END || CASE WHEN authors[2] = ' ' THEN ['author'] ELSE [] END || CASE WHEN authors[1] = 'Lee, Ann' THEN ['author_delimiter'] ELSE [] END AS codes, sid AS path FROM r),
s AS (SELECT snapshot, any_value(lang) AS lang, count(*) AS n, sum(strlen(title) + strlen(coalesce(text, '')) + strlen(decision) + strlen(array_to_string(authors, ''))) AS bytes, bool_or(doc_id % 50 = 0) AS changed FROM r GROUP BY snapshot HAVING snapshot <> 'src4-es'),
od AS (SELECT DISTINCT snapshot FROM (SELECT snapshot, sid, lag(sid) OVER (PARTITION BY snapshot ORDER BY CASE WHEN lang = 'de' THEN -doc_id ELSE doc_id END, copy) AS before FROM r) WHERE before > sid)
SELECT snapshot, unnest(codes) AS code, path FROM f
UNION ALL SELECT snapshot, 'duplicate_id', 'source_id:' || sid FROM r GROUP BY snapshot, sid HAVING count(*) > 1
UNION ALL SELECT snapshot, 'duplicate_id', 'paper_id:' || left(sha256('lectern:v1:openreview:' || lpad(CAST(doc_id AS VARCHAR), 12, '0')), 40) FROM r GROUP BY snapshot, doc_id HAVING count(*) > 1
UNION ALL SELECT snapshot, 'duplicate_id', 'url:https://forum.example/?id=' || sid FROM r GROUP BY snapshot, sid HAVING count(*) > 1
UNION ALL SELECT snapshot, 'row_order', 'rows' FROM od
UNION ALL SELECT snapshot, 'rows', 'header' FROM s WHERE n > 30
UNION ALL SELECT snapshot, 'text_bytes', 'header' FROM s WHERE bytes > 80000
UNION ALL SELECT snapshot, 'unknown_decisions', 'header' FROM s WHERE snapshot LIKE 'src3-%'
UNION ALL SELECT snapshot, 'statistics', 'header' FROM s WHERE snapshot LIKE 'src3-%' OR lang = 'es'
UNION ALL SELECT snapshot, 'fingerprint', 'header' FROM s WHERE lang = 'fr' AND changed
UNION ALL SELECT DISTINCT snapshot, 'header_missing', 'header' FROM r WHERE snapshot = 'src4-es'""")
def candidate_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents of a language as a landed snapshot with its header; rows, order, statistics and digest have
    planted faults. The limits of rows and bytes are low, so that some snapshots break them."""
    c = F.col
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    sid = F.lpad(c("doc_id").cast("string"), 12, "0")
    lists = F.when(c("doc_id") % 47 == 0, F.array().cast("array<string>")).when(c("doc_id") % 59 == 0, F.array(F.lit("Lee, Ann"))).when(c("doc_id") % 61 == 0, F.array(F.lit("A"), F.lit(" "))).otherwise(F.array(F.lit("Ann Lee"), F.lit("Bo")))
    flat = docs.select(
        F.concat_ws("-", "source", "lang").alias("snapshot"), "lang", "doc_id", stable_id(F.lit("openreview"), sid).alias("paper_id"), F.when(c("doc_id") % 41 == 0, "no id").otherwise(sid).alias("source_id"),
        F.when(c("doc_id") % 97 == 0, " ").when(c("doc_id") % 53 == 0, "same").otherwise(F.concat(F.lit("T"), "doc_id")).alias("title"), c("text").alias("abstract"),
        F.when(c("doc_id") % 37 == 0, "").when(c("doc_id") % 7 == 0, "Withdrawn").when(c("doc_id") % 2 == 0, " Oral ").otherwise("poster").alias("decision"), lists.alias("authors"), _copies(c("doc_id") % 43 == 0).alias("copy"),
    ).withColumns({"url": F.concat(F.lit("https://forum.example/?id="), "source_id"), "turn": F.when(c("lang") == "de", -c("doc_id")).otherwise(c("doc_id"))})
    rows = materialize(snapshots.places(flat, "snapshot", ["turn", "copy"]).withColumnRenamed("place", "pos"), "snapshots")
    content = ["source_id", "title", "abstract", "decision"]
    stored = rows.withColumn("abstract", F.when((c("lang") == "fr") & (c("doc_id") % 50 == 0), "another text").otherwise(c("abstract")))
    digests = snapshots.ordered_digests(stored, "snapshot", ["pos"], content).select("snapshot", c("digest").alias("fingerprint"))
    odd = rows.groupBy("snapshot").agg(F.count_if(c("decision") == "").alias("blank"), F.count_if(c("decision") == "Withdrawn").alias("gone"))
    titles = rows.groupBy("snapshot", "lang", "title").count().groupBy("snapshot", "lang").agg(F.sum(c("count") - 1).alias("twice"))
    def entry(name: str, n: str) -> Column:
        return F.when(c(n) > 0, F.struct(F.lit(name).alias("label"), c(n).alias("n")))

    sound = F.array_compact(F.array(entry("", "blank"), entry("withdrawn", "gone")))
    wrong = F.array(F.struct(F.lit("z").alias("label"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("a").alias("label"), F.lit(1).cast("long").alias("n")))
    headers = titles.join(odd, "snapshot").join(digests, "snapshot").where("snapshot <> 'src4-es'").select("snapshot", (c("twice") + F.when(c("lang") == "es", 1).otherwise(0)).alias("duplicate_titles"), F.when(c("snapshot").startswith("src3-"), wrong).otherwise(sound).alias("unknown"), "fingerprint")
    expected = stable_id(F.lit("openreview"), c("source_id"))
    return snapshots.snapshot_faults(headers, rows, expected, "https://forum.example/?id=", ("oral", "poster"), content, most_rows=30, most_bytes=80_000)


@query("K06 V08", """WITH d AS (SELECT doc_id, coalesce(source, 'none') AS conference, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS oral FROM documents),
a AS (SELECT conference, count(*) AS papers, CAST(sum(oral) AS BIGINT) AS orals FROM d WHERE doc_id % 10 <> 9 GROUP BY conference), b AS (SELECT conference, count(*) AS papers, CAST(sum(oral) AS BIGINT) AS orals FROM d GROUP BY conference),
lost AS (SELECT conference, count(*) AS n, CAST(sum(oral) AS BIGINT) AS o FROM d WHERE doc_id % 10 <> 9 AND doc_id % 7 = 0 GROUP BY conference),
more AS (SELECT conference, count(*) AS n, CAST(sum(oral) AS BIGINT) AS o FROM d WHERE doc_id % 10 = 9 AND doc_id % 7 <> 0 GROUP BY conference),
net AS (SELECT conference, coalesce(lost.n, 0) - coalesce(more.n, 0) AS n, coalesce(lost.o, 0) - coalesce(more.o, 0) AS o FROM a LEFT JOIN lost USING (conference) LEFT JOIN more USING (conference))
SELECT 1 AS step, conference, 'visible' AS told, papers, orals FROM a UNION ALL SELECT 2, conference, 'visible', papers, orals FROM a UNION ALL SELECT 3, conference, 'visible', papers, orals FROM b UNION ALL SELECT 4, conference, 'visible', papers, orals FROM a
UNION ALL SELECT 2, conference, 'lost_ids', n, NULL FROM lost UNION ALL SELECT 2, conference, 'fewer_papers', n, NULL FROM net WHERE n > 0 UNION ALL SELECT 2, conference, 'fewer_orals', o, NULL FROM net WHERE o > 0""")
def published_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see after each step: a catalog is published; one that lacks papers is refused, with its faults, and
    readers still see the first; a grown one is published; the first is made visible again."""
    root = _place(spark, "catalog")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source", F.lit("none")).alias("conference"), stable_id(F.lit("doc"), F.col("doc_id").cast("string")).alias("paper_id"), F.when(F.col("doc_id") % 4 == 0, "Oral").otherwise("Poster").alias("type"), F.col("text").alias("abstract"), F.lit("Ann Lee").alias("authors"))

    def seen(step: int) -> DataFrame:
        rows = published.current(spark, root).groupBy("conference").agg(F.count("*").alias("papers"), F.count_if(F.col("type") == "Oral").alias("orals"))
        return rows.select(F.lit(step).alias("step"), "conference", F.lit("visible").alias("told"), "papers", "orals")

    _sound(published.publish(docs.where("doc_id % 10 <> 9"), root))
    first = seen(1)
    refused = published.publish(docs.where("doc_id % 7 <> 0"), root)
    told = spark.createDataFrame([(2, *f, None) for f in refused], "step int, conference string, told string, papers long, orals long")
    second = seen(2)
    _sound(published.publish(docs, root))
    third = seen(3)
    published.rollback(spark, root, 1)
    return first.unionByName(told).unionByName(second).unionByName(third).unionByName(seen(4))


def _sound(faults: list[tuple[str, str, int]]) -> None:
    if faults:
        raise ValueError(f"not published: {faults[:5]}")
