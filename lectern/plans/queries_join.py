"""Join, matching, deduplication and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.highlight import client_key
from lectern.operators import dedup, gates, structure, windows
from lectern.plans.registry import query
from lectern.plans.storage import spread
from lectern.plans.views import EDGES_SQL, PAPERS_SQL, edges, nodes, papers, table


@query("D02 U02", """SELECT min(doc_id) AS doc_id, sha256(text) AS uid, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text""")
def uid_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("uid"))
    return docs.groupBy("uid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("D03 R12")
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are aliases of one another if they share a part: components over the bipartite links. The closure of
    the whole table is too much for recursive SQL; tested against a plain version."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return dedup.components_by_key(rows, "l_orderkey", "l_partkey")


@query("D04")
def title_year_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("10.1/"), F.col("p_brand"), F.lit("-"), F.col("p_size")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_type", "p_brand").alias("title_key"), (1990 + F.col("p_size")).alias("year"), doi.alias("doi"), F.col("p_retailprice").alias("cites"))
    return dedup.merge_title_years(rows)


@query("D19", """SELECT p_partkey, coalesce(NULLIF(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, ''), p_brand) AS title, greatest(p_retailprice, CAST(coalesce(n, 0) AS DOUBLE)) AS cites, CASE WHEN coalesce(n, 0) > p_retailprice THEN 'lines' ELSE 'part' END AS cites_from FROM part LEFT JOIN (SELECT l_partkey, count(*) * 40 AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field: the first source's value, blanks filled from the second, the larger count with its source."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.count("*") * 40).alias("n"))
    both = table(spark, sf_dir, "part").join(counts, "p_partkey", "left")
    other, own = F.coalesce("n", F.lit(0)).cast("double"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name"))
    return both.select("p_partkey", F.coalesce(F.nullif(own, F.lit("")), "p_brand").alias("title"), F.greatest("p_retailprice", other).alias("cites"), F.when(other > F.col("p_retailprice"), "lines").otherwise("part").alias("cites_from"))


@query("J08 J09 J10")
def linked_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' and suppliers' invented papers: most titles agree, some have a mistyped word, some authors only."""
    from lectern.operators.linking import link

    def papers_of(df: DataFrame, key: str, typo: bool) -> DataFrame:
        k = F.col(key)
        word = F.when(k % 5 == 0, "standart" if typo else "standard").otherwise("measured")
        title = F.concat(F.lit("on "), word, F.lit(" nation "), (k % 977).cast("string"), F.lit(" of part "), (k % 31).cast("string"))
        return df.select(k.alias("id"), title.alias("title"), F.array(F.concat(F.lit("Ann Lee"), (k % 400).cast("string")), F.concat(F.lit("Bo Yu"), (k % 7).cast("string"))).alias("authors"))

    rows = papers_of(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", True)
    records = papers_of(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", False)
    return link(rows, records.withColumnRenamed("id", "record"))


@query("D06 D10 D11 P21", f"""WITH {EDGES_SQL}, s AS (SELECT id, min(id) OVER (PARTITION BY graph_id, yr) AS kept FROM o),
m AS (SELECT graph_id, a.kept AS src, b.kept AS dst, gap, src AS s0, dst AS d0 FROM edges JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE a.kept <> b.kept)
SELECT graph_id, src, dst FROM m GROUP BY ALL""")
def merged_title_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one graph and year are one record; edges move to the survivor, loops and repeats go."""
    kept = nodes(spark, sf_dir).select("id", F.min("id").over(Window.partitionBy("graph_id", "yr")).alias("kept"))
    return dedup.remap_edges(edges(spark, sf_dir).select("graph_id", "src", "dst"), kept, "id", "kept")


@query("D07", """WITH p AS (SELECT p_partkey, p_name, p_size, p_brand, string_split(p_name, ' ')[1] AS prefix FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.prefix = b.prefix AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 1
WHERE len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) = len(string_split(a.p_name, ' '))""")
def versioned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names meet as names: rows are joined only where their names agree and their sizes are at most one apart."""
    from lectern.operators.matching import contained_names

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), "p_size", "p_brand", F.substring_index("p_name", " ", 1).alias("prefix"))
    within = contained_names(p.select("p_brand", "prefix", "name").where("prefix is not null and p_brand is not null").distinct(), ["p_brand", "prefix"])
    near = F.explode(F.array(*(F.col("p_size") + k for k in (-1, 0, 1)))).alias("p_size")
    a = p.select(F.col("p_partkey").alias("a"), "p_brand", F.col("name").alias("inner"), near).join(within.drop("prefix"), ["p_brand", "inner"])
    b = p.select(F.col("p_partkey").alias("b"), "p_brand", F.col("name").alias("outer"), "p_size")
    keys = ["p_brand", "outer", "p_size"]
    return spread(a.select("a", *keys), *keys).join(b, keys).where("a < b").select("a", "b")


@query("D09 J12", """WITH a AS (SELECT c_nationkey AS alias, c_custkey AS paper, c_acctbal AS cites FROM customer)
SELECT n_nationkey, count(DISTINCT paper) AS papers, count(DISTINCT paper) > 1 AS ambiguous, min(paper) FILTER (WHERE r = 1) AS best FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY cites DESC, paper) AS r FROM a) ON alias = n_nationkey GROUP BY n_nationkey""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("papers"), F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("top"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(owned, "n_nationkey", "left").select(
        "n_nationkey", F.coalesce("papers", F.lit(0)).alias("papers"), (F.coalesce("papers", F.lit(0)) > 1).alias("ambiguous"), (-F.col("top.k")).alias("best"))


@query("D15 G20", f"""WITH {PAPERS_SQL}, k AS (SELECT source, title, count(*) AS n FROM papers GROUP BY source, title) SELECT source, CAST(sum(n) AS BIGINT) AS papers, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS duplicates, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS collisions FROM k GROUP BY source""")
def identity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = papers(spark, sf_dir).groupBy("source", "title").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.sum("n").alias("papers"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("duplicates"), F.count_if(F.col("n") > 1).alias("collisions"))


@query("D17", """SELECT k, min(p) AS priority FROM (SELECT lower(p_name) AS k, 0 AS p FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT lower(p_brand), 1 FROM part) GROUP BY k ORDER BY min(p), k LIMIT 60""")
def keyword_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = part.where("p_partkey % 5 = 0").select(F.lower("p_name").alias("k"), F.lit(0).alias("p")).unionByName(part.select(F.lower("p_brand").alias("k"), F.lit(1).alias("p")))
    return words.groupBy("k").agg(F.min("p").alias("priority")).orderBy("priority", "k").limit(60)


@query("J03 J20", """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 200 AS looked FROM orders)
SELECT o_orderkey, coalesce(c.c_name, 'repo-' || o_custkey) AS repo FROM r LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON c.c_custkey = r.o_custkey WHERE looked""")
def budgeted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the best rows are looked up; the curated table wins over the fallback."""
    asked = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_custkey")
    curated = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return asked.join(curated, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("repo-"), F.col("o_custkey"))).alias("repo"))


@query("J04 J24 S20", """SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 45""")
def id_batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey").join(urgent, "l_orderkey")


@query("J21", """WITH l AS (SELECT s_suppkey, s_nationkey, CAST(floor(s_acctbal / 50) AS BIGINT) AS k FROM supplier), r AS (SELECT c_custkey, c_nationkey, CAST(floor(c_acctbal / 50) AS BIGINT) AS k FROM customer)
SELECT s_suppkey, c_custkey FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey, k) AS n FROM l) a JOIN (SELECT *, count(*) OVER (PARTITION BY c_nationkey, k) AS n FROM r) b ON s_nationkey = c_nationkey AND a.k = b.k WHERE a.n = 1 AND b.n = 1""")
def unique_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(":", "s_nationkey", F.floor(F.col("s_acctbal") / 50)).alias("key"))
    right = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(":", "c_nationkey", F.floor(F.col("c_acctbal") / 50)).alias("key"))
    return windows.unique_match(left, right, "key").select("s_suppkey", "c_custkey")


@query("J07 U06", """WITH a AS (SELECT DISTINCT p_name AS k FROM part WHERE p_size < 25), b AS (SELECT DISTINCT p_name AS k FROM part WHERE p_size > 20 AND p_partkey % 3 = 0)
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k""")
def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return gates.reconcile(part.where("p_size < 25").select("p_name"), part.where("p_size > 20 and p_partkey % 3 = 0").select("p_name"), "p_name")


@query("J12", """SELECT o_orderkey, l_partkey AS best FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 365 DAY AND o_orderdate + INTERVAL 1095 DAY
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity DESC, l_discount DESC, l_partkey, l_linenumber) = 1""")
def best_match_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity", "l_discount", "l_shipdate", "l_linenumber")
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(lines, "o_orderkey")
    near = both.where(F.col("l_shipdate").between(F.col("o_orderdate") - F.expr("INTERVAL 365 DAY"), F.col("o_orderdate") + F.expr("INTERVAL 1095 DAY")))
    return windows.first_by(near, ["o_orderkey"], [F.desc("l_quantity"), F.desc("l_discount"), F.asc("l_partkey"), F.asc("l_linenumber")]).select("o_orderkey", F.col("l_partkey").alias("best"))


@query("J11", """SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'native' WHEN quality = 1 THEN 'replacement' ELSE 'none' END AS abstract_source FROM documents LEFT JOIN labels USING (doc_id)""")
def abstract_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("source").isin("src0", "src1"), "native").when(F.col("quality") == 1, "replacement").otherwise("none").alias("abstract_source"))


@query("J13 R29", """SELECT DISTINCT l_partkey AS node, l_suppkey AS slug FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')""")
def theme_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(wanted, "l_partkey", "left_semi").distinct().toDF("node", "slug")


@query("J14 R14 G28", f"""WITH {EDGES_SQL} SELECT dst AS node, count(*) FILTER (WHERE relation = 'supersedes') AS supersedes, count(*) FILTER (WHERE relation = 'extends') AS extends, count(*) FILTER (WHERE relation IN ('contrasts', 'baseline_only')) AS weak, count(DISTINCT src) AS prior FROM edges GROUP BY dst""")
def position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.col("relation")
    return edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(
        F.count_if(relation == "supersedes").alias("supersedes"), F.count_if(relation == "extends").alias("extends"), F.count_if(relation.isin("contrasts", "baseline_only")).alias("weak"), F.countDistinct("src").alias("prior"))


@query("J15 J16 J17 U10", f"""WITH {EDGES_SQL}, have AS (SELECT graph_id, src, dst FROM edges WHERE gap = 1), found AS (SELECT graph_id, src, dst FROM edges WHERE gap = 2 AND src_year <= dst_year)
SELECT f.graph_id, f.src, f.dst FROM found f ANTI JOIN have h ON f.src = h.src AND f.dst = h.dst ANTI JOIN have r ON f.src = r.dst AND f.dst = r.src""")
def cross_node_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_edges = edges(spark, sf_dir)
    have = all_edges.where("gap = 1").select("src", "dst")
    either = have.unionByName(have.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return all_edges.where("gap = 2 and src_year <= dst_year").select("graph_id", "src", "dst").join(either, ["src", "dst"], "left_anti")


@query("J18", """SELECT a.p_partkey, max(b.p_size) AS parent_version FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND b.p_size < a.p_size GROUP BY a.p_partkey""")
def version_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest version below each: a range frame over versions instead of a self join."""
    below = Window.partitionBy("p_name", "p_brand").orderBy("p_size").rangeBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "part").select("p_partkey", F.max("p_size").over(below).alias("parent_version")).where("parent_version is not null")


@query("J19 J25 J26", """WITH w AS (SELECT n_nationkey, y FROM nation, range(1996, 2000) r(y) WHERE n_nationkey % 2 = 0), p AS (SELECT DISTINCT c_nationkey, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_totalprice > 480000)
SELECT w.n_nationkey, CAST(w.y AS BIGINT) AS edition FROM w ANTI JOIN p ON p.c_nationkey = w.n_nationkey AND p.y = w.y""")
def pending_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.explode(F.sequence(F.lit(1996), F.lit(1999))).alias("y"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    published = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").select("n_nationkey", "y").distinct()
    return watched.join(published, ["n_nationkey", "y"], "left_anti").select("n_nationkey", F.col("y").cast("long").alias("edition"))


@query("J21 J27", """SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) = 1 THEN c_name END AS only_row FROM customer""")
def unique_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("c_nationkey", "c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(n == 1, F.col("c_name")).alias("only_row"))


@query("J23", """SELECT o_orderkey, bool_or(l_partkey % 100 = o_orderkey % 100 OR l_suppkey = o_custkey) AS listed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def reference_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join and a partial "or" for each order: no order's references are held at once."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(refs, "o_orderkey")
    same = (F.col("l_partkey") % 100 == F.col("o_orderkey") % 100) | (F.col("l_suppkey") == F.col("o_custkey"))
    return orders.groupBy("o_orderkey").agg(F.bool_or(same).alias("listed"))


@query("U03", """WITH old AS (SELECT doc_id, source FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT doc_id, source FROM documents WHERE doc_id % 7 <> 2)
SELECT (SELECT count(*) FROM old) AS before, (SELECT count(*) FROM new) AS after, (SELECT count(*) FROM old ANTI JOIN new USING (doc_id)) AS lost, (SELECT count(*) FROM new ANTI JOIN old USING (doc_id)) AS gained, (SELECT count(*) FROM new) < 0.9 * (SELECT count(*) FROM old) AS refused""")
def shrink_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return gates.shrink(docs.where("doc_id % 10 <> 3"), docs.where("doc_id % 7 <> 2"), "doc_id", 0.9)


@query("U07", """WITH a AS (SELECT conv_id, turn, role FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'system' ELSE role END AS role FROM conversations WHERE NOT (conv_id % 11 = 0 AND turn = 1))
SELECT '/' || conv_id || '/' || turn || '/role' AS pointer, CASE WHEN b.role IS NULL THEN 'missing' ELSE 'changed' END AS kind FROM a LEFT JOIN b USING (conv_id, turn) WHERE a.role IS DISTINCT FROM b.role""")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    other = talk.where("not (conv_id % 11 = 0 and turn = 1)").withColumn("role", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), "system").otherwise(F.col("role")))
    def flat(df: DataFrame) -> DataFrame:
        return df.select(F.concat(F.lit("/"), F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit("/role")).alias("pointer"), F.col("role").alias("value"))

    return gates.diff(flat(talk), flat(other), "pointer", "value")


@query("U10 R16", f"""WITH {EDGES_SQL}, e AS (SELECT graph_id, src, dst, src_year - dst_year AS inv FROM edges WHERE gap = 1 UNION ALL SELECT graph_id, dst, src, dst_year - src_year FROM edges WHERE gap = 1 AND src % 3 = 0)
SELECT graph_id, src, dst FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.src = x.dst AND y.dst = x.src AND (y.inv < x.inv OR (y.inv = x.inv AND y.src < x.src)))""")
def reverse_edge_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two opposite edges the one without year inversion stays, else that of the smaller source."""
    forward = edges(spark, sf_dir).where("gap = 1").select("graph_id", "src", "dst", (F.col("src_year") - F.col("dst_year")).alias("inv"))
    back = forward.where("src % 3 = 0").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("inv")).alias("inv"))
    return dedup.one_direction(forward.unionByName(back), [F.asc("inv"), F.asc("src")]).select("graph_id", "src", "dst")


@query("P13", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE coalesce(l_returnflag <> 'N', true) AND (l_extendedprice <= 2 * o_totalprice OR l_linestatus = 'O') AND length(trim(o_orderpriority)) >= 6""")
def offtopic_reference_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").where(F.coalesce(F.col("l_returnflag") != "N", F.lit(True)))
    both = lines.join(orders.where(F.char_length(F.trim("o_orderpriority")) >= 6), "l_orderkey")
    return both.where("l_extendedprice <= 2 * o_totalprice or l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_partkey")


@query("F57", """SELECT user_id, CASE WHEN user_id % 2 = 0 THEN '2001:0db8:' || lpad(lower(to_hex(user_id)), 4, '0') || ':0000::/64' ELSE '10.0.0.' || user_id END AS client, count(*) AS n FROM events GROUP BY user_id""")
def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses are reduced to the part that names a client."""
    address = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("2001:db8:"), F.lower(F.hex("user_id")), F.lit("::A"))).otherwise(F.concat(F.lit("10.0.0."), F.col("user_id")))
    return table(spark, sf_dir, "events").select("user_id", client_key(address).alias("client")).groupBy("user_id", "client").agg(F.count("*").alias("n"))


@query("U07", """SELECT p_partkey AS doc, x.pointer, x.kind FROM part, LATERAL (SELECT unnest(CASE p_partkey % 4
  WHEN 0 THEN [{'pointer': '/spec/size', 'kind': 'value_mismatch'}]
  WHEN 1 THEN [{'pointer': '/list', 'kind': 'length_mismatch'}, {'pointer': '/list/1', 'kind': 'missing_in_actual'}]
  WHEN 2 THEN [{'pointer': '/spec/brand', 'kind': 'missing_in_actual'}, {'pointer': '/spec/make', 'kind': 'missing_in_expected'}]
  ELSE [{'pointer': '/name', 'kind': 'type_mismatch'}] END) AS x)""")
def nested_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers at which nested documents differ, in each kind of difference; times of reading are ignored."""
    k, size = F.col("p_partkey"), F.col("p_size")

    def document(name, spec, items, at: str):
        return F.concat(F.lit('{"name": '), name, F.lit(', "spec": '), spec, F.lit(', "list": '), items, F.lit(f', "read": [{{"at": "{at}"}}]}}'))

    def spec(number, brand: str):
        return F.format_string(f'{{"size": %d, "{brand}": "%s"}}', number, "p_brand")

    name, items = F.format_string('"%s"', "p_name"), F.format_string("[%d, %d.0]", size, size)
    expected = document(name, spec(size, "brand"), items, "2020")
    actual = document(
        F.when(k % 4 == 3, F.concat(F.lit("["), name, F.lit("]"))).otherwise(name), F.when(k % 4 == 0, spec(size + 1, "brand")).when(k % 4 == 2, spec(size, "make")).otherwise(spec(size, "brand")),
        F.when(k % 4 == 1, F.format_string("[%d]", size)).otherwise(F.format_string("[%d.0, %d]", size, size)), "2021",
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", expected.alias("expected"), actual.alias("actual"))
    return structure.json_diff(rows, "p_partkey", "expected", "actual", ignore=["/read/*/at"]).select("doc", "pointer", "kind")
