"""Queries that judge, repair and match literature records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import identity, records, text
from lectern.operators import records as matching
from lectern.plans.registry import query
from lectern.plans.views import EDGES_SQL, TITLE_SQL, edges, nodes, table, title_of

_B, _E = "(?:^|[^0-9A-Za-z_])", "(?:[^0-9A-Za-z_]|$)"


@query("F04", """WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Accepted at the ICML ' || c_nationkey WHEN 'MACHINERY' THEN 'to appear in CVPR Workshop' WHEN 'AUTOMOBILE' THEN 'Published at WWW' WHEN 'HOUSEHOLD' THEN 'a workshop paper, accepted by ' || c_name ELSE 'accepted to nobody' END AS comment FROM customer),
n AS (SELECT c_custkey, upper(regexp_extract(comment, '(?i)\\b(?:accepted (?:at|to|by)|to appear (?:at|in)|published (?:at|in))\\s+(?:the\\s+)?([A-Za-z]+)', 1)) AS v, regexp_matches(comment, '(?i)\\bworkshop\\b') AS w FROM c),
t AS (SELECT *, CASE WHEN v IN ('NEURIPS', 'NIPS', 'ICML', 'ICLR') THEN 1 WHEN v IN ('AAAI', 'CVPR', 'ACL', 'EMNLP') THEN 2 WHEN v IN ('AISTATS', 'NAACL', 'ECCV', 'ICCV', 'IJCAI', 'KDD', 'WWW') THEN 3 ELSE 0 END AS k FROM n)
SELECT c_custkey, CASE WHEN k > 0 AND w THEN v || ' Workshop' WHEN k > 0 THEN v WHEN w THEN 'Workshop' END AS venue, CASE WHEN w THEN 4 ELSE k END AS tier, CASE WHEN w THEN 30 WHEN k = 0 THEN 0 ELSE 120 - 20 * k END AS score FROM t""")
def comment_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    comment = (
        F.when(segment == "BUILDING", F.concat(F.lit("Accepted at the ICML "), F.col("c_nationkey"))).when(segment == "MACHINERY", "to appear in CVPR Workshop")
        .when(segment == "AUTOMOBILE", "Published at WWW").when(segment == "HOUSEHOLD", F.concat(F.lit("a workshop paper, accepted by "), F.col("c_name"))).otherwise("accepted to nobody")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", records.comment_venue(comment).alias("v")).select("c_custkey", "v.venue", "v.tier", "v.score")


@query("F50", """SELECT o_orderkey, CASE lower(x) WHEN 'spotlightposter' THEN 'Spotlight' ELSE upper(substr(lower(x), 1, 1)) || substr(lower(x), 2) END AS decision
FROM (SELECT o_orderkey, regexp_extract('Conf ' || year(o_orderdate) || ' ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'ORAL' WHEN '2-HIGH' THEN 'spotlightposter' WHEN '3-MEDIUM' THEN 'Spotlight' WHEN '5-LOW' THEN 'poster' ELSE 'accept' END, '(?i)\\b(oral|spotlightposter|spotlight|poster)\\b', 1) AS x FROM orders)""")
def decision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    word = F.when(priority == "1-URGENT", "ORAL").when(priority == "2-HIGH", "spotlightposter").when(priority == "3-MEDIUM", "Spotlight").when(priority == "5-LOW", "poster").otherwise("accept")
    return table(spark, sf_dir, "orders").select("o_orderkey", records.decision_label(F.concat_ws(" ", F.lit("Conf"), F.year("o_orderdate"), word)).alias("decision"))


_WORDS3 = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}'))"


@query("F23", f"""WITH p AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') || '-code' ELSE p_brand || ' ' || p_name || ' ' || p_type END AS b FROM part),
k AS (SELECT *, regexp_replace(lower(a), '[^a-z0-9]+', '', 'g') AS x, regexp_replace(lower(b), '[^a-z0-9]+', '', 'g') AS y, {_WORDS3.format('a')} AS v, {_WORDS3.format('b')} AS w FROM p)
SELECT p_partkey, round(CASE WHEN length(x) >= 6 AND length(y) >= 6 AND (contains(x, y) OR contains(y, x)) THEN 1.0 WHEN len(v) = 0 OR len(w) = 0 THEN 0.0 ELSE len(list_intersect(v, w)) / len(list_distinct(list_concat(v, w))) END, 6) AS similarity FROM k""")
def repository_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("-code"))).otherwise(F.concat_ws(" ", "p_brand", name, "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(records.repository_similarity(name, other), 6).alias("similarity"))


@query("P09 P15 P16 P17", rf"""WITH d AS (SELECT doc_id, {TITLE_SQL} AS title, text, source, lang FROM documents)
SELECT doc_id, regexp_matches(title, '(?i){_B}(?:surveys?|overview|tutorial|primer|literature\s+review|systematic\s+review|introduction\s+to|perspectives?\s+(?:on|of|for)){_E}') OR regexp_matches(title, '(?i){_B}reviews?(?:[^0-9A-Za-z_-]|$)')
    OR regexp_matches(title, '(?i){_B}(?:a\s+comprehensive|recent\s+(?:advances|progress|developments|trends)|challenges\s+and\s+opportunities|opportunities\s+and\s+challenges|state[\s-]of[\s-]the[\s-]art\s+(?:and|in|on|of|review|survey)){_E}')
    OR regexp_matches(title, '(?i)^(?:an?\s+)?(?:comprehensive\s+|brief\s+|short\s+|recent\s+)?(?:survey|review|tutorial|overview|perspective|roadmap|primer)(?:[^0-9A-Za-z_-]|$)|:\s*(?:an?\s+|the\s+)?(?:survey|review|tutorial|overview|perspective|roadmap|primer|state[\s-]of[\s-]the[\s-]art){_E}')
    OR regexp_matches(text, '(?i){_B}(?:in\s+)?this\s+(?:review|survey|tutorial|overview){_E}|{_B}comprehensive\s+(?:overview|survey|review){_E}|{_B}we\s+(?:comprehensively\s+|systematically\s+)?survey{_E}|{_B}we\s+summari[sz]e\s+(?:the\s+)?recent{_E}')
    OR regexp_matches(text, '(?i){_B}(?:in\s+)?this\s+(?:article|paper|work|chapter)\s+(?:we\s+)?(?:reviews?|surveys?){_E}|{_B}we\s+(?:provide|present|give|offer)\s+(?:an?\s+|the\s+)?(?:(?:comprehensive|systematic|thorough|brief|broad|detailed|extensive|up-to-date|concise)\s+)*(?:overview|survey|review){_E}')
    OR regexp_matches(regexp_replace(text, '(?i)we\s+(?:\w+ly\s+)?review\s+(?:the\s+)?(?:related|background|prior\s+work\s+in)', '', 'g'), '(?i){_B}we\s+(?:comprehensively\s+|systematically\s+|critically\s+|extensively\s+)?review{_E}') AS survey,
  regexp_matches(title, '(?i){_B}(?:data\s*sets?|benchmarks?|database|corpus|corpora){_E}') OR regexp_matches(text, '(?i){_B}(?:introduce|introduces|introducing|present|presents|release|releases|collect|collected|construct|constructed|build|built|propose|proposes)\b[^.]{{0,80}}\b(?:data\s*set|dataset|benchmark|database|corpus){_E}') AS dataset,
  trim(title) = '' OR regexp_matches(regexp_replace(trim(title), '[.:;,!?]+$', ''), '^[A-Za-z][a-z]+(?:\s+[A-Za-z][a-z]+)?$') AND (lang = 'de' OR source = 'src0') AS bogus,
  doc_id IN (7, 11) OR regexp_matches(title, '^The ') AS denied FROM d""")
def record_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveys, datasets, unusable and denied records among the documents; those of one language count as undated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", title_of(F.col("text")).alias("title"), "text", "source", "lang")
    title, nothing = F.col("title"), F.lit(None).cast("string")
    return docs.select(
        "doc_id", records.is_survey(title, F.col("text"), F.col("source"), nothing).alias("survey"), records.is_dataset(title, F.col("text")).alias("dataset"),
        records.is_bogus(title, F.when(F.col("lang") != "de", 2020), F.lit(2), F.when(F.col("source") != "src0", F.col("source"))).alias("bogus"),
        records.is_denied(F.col("doc_id").cast("string"), title, ["7", "11"], ["^The "]).alias("denied"),
    )


@query("R17 F16 F17", """WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority AS p, o_custkey FROM orders),
x AS (SELECT *, CASE WHEN p = '1-URGENT' THEN strftime(make_date(y + 1, 1, 1), '%y') || '05.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') WHEN p = '2-HIGH' THEN 'cs.LG/' || strftime(make_date(y, 1, 1), '%y') || '07123' END AS pre FROM o),
z AS (SELECT *, CASE WHEN p = '1-URGENT' THEN CASE WHEN y + 1 >= 2000 THEN y + 1 ELSE y + 101 END WHEN p = '2-HIGH' THEN y END AS pre_year FROM x)
SELECT o_orderkey, pre_year, CASE WHEN coalesce(pre_year <= y, false) THEN y WHEN p = '3-MEDIUM' AND abs(o_custkey % 3 - 1) = 1 THEN y + CAST(o_custkey % 3 - 1 AS INTEGER) WHEN p <> '3-MEDIUM' AND o_custkey % 2 = 0 THEN y + 1 ELSE y END AS year FROM z""")
def corrected_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-year slips of proceedings: a conference listing, else the year in a proceedings DOI, unless the preprint dates it."""
    year, priority = F.year("o_orderdate"), F.col("o_orderpriority")
    number = F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")
    pre = F.when(priority == "1-URGENT", F.concat(F.substring((year + 1).cast("string"), 3, 2), F.lit("05."), number)).when(priority == "2-HIGH", F.concat(F.lit("cs.LG/"), F.substring(year.cast("string"), 3, 2), F.lit("07123")))
    doi = F.concat(F.lit("10.1109/icde-x."), (year + 1).cast("string"), F.lit("."), F.col("o_orderkey"))
    listed, key = year + (F.col("o_custkey") % 3 - 1).cast("int"), F.when(priority == "3-MEDIUM", F.concat(F.lit("conf/x/"), F.col("o_orderkey"))).otherwise("journals/x")
    venue = F.when((F.col("o_custkey") % 2 == 0) & (priority != "3-MEDIUM"), "A Conference").otherwise("Letters")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", year.alias("y"), pre.alias("pre"), doi.alias("doi"), listed.alias("listed"), key.alias("key"), venue.alias("venue"))
    return rows.select("o_orderkey", records.preprint_year(F.col("pre")).alias("pre_year"), records.corrected_year(F.col("y"), F.col("pre"), F.col("listed"), F.col("key"), F.col("venue"), F.col("doi")).alias("year"))


@query("D21 D22 F32", """WITH p AS (SELECT p_partkey, p_name || ' for ' || p_type AS t, CASE p_partkey % 4 WHEN 0 THEN 'Design of ' || p_brand || ' systems under load' ELSE p_name || ' for ' || p_type END AS u, p_partkey % 5 = 0 AS other FROM part),
w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')), lambda x: x NOT IN ('a', 'an', 'the', 'of', 'on', 'in', 'for', 'and', 'to', 'with', 'via')) AS a, list_filter(list_distinct(regexp_extract_all(lower(u), '[a-z0-9]+')), lambda x: x NOT IN ('a', 'an', 'the', 'of', 'on', 'in', 'for', 'and', 'to', 'with', 'via')) AS b FROM p),
j AS (SELECT *, len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) AS s FROM w), r AS (SELECT *, t <> u AND ((len(a) >= 2 AND len(b) >= 2 AND s < 0.3) OR (len(a) >= 3 AND len(b) >= 3 AND s < 0.5)) AS retitled FROM j)
SELECT p_partkey, CASE WHEN retitled THEN u ELSE t END AS title, CASE WHEN other THEN 'Cy Ma' ELSE 'Ann Lee; Bo Yu' END AS authors, NOT other AS has_doi, list_filter([CASE WHEN other THEN 'authors' END, CASE WHEN retitled THEN 'title' END], lambda x: x IS NOT NULL) AS changed FROM r""")
def repaired_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat_ws(" for ", "p_name", "p_type")
    other = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Design of "), F.col("p_brand"), F.lit(" systems under load"))).otherwise(title)
    theirs = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("Cy Ma"))).otherwise(F.array(F.lit("A. Lee")))
    fixed = records.corrected_identity(title, F.array(F.lit("Ann Lee"), F.lit("Bo Yu")), F.lit("10.1/x"), F.lit("text"), other, theirs)
    return table(spark, sf_dir, "part").select("p_partkey", fixed.alias("r")).select("p_partkey", "r.title", F.array_join("r.authors", "; ").alias("authors"), F.col("r.doi").isNotNull().alias("has_doi"), "r.changed")


@query("D01 D02", """WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN lpad(CAST(page_id % 40 AS VARCHAR), 4, '1') || '.00001' END AS arxiv, CASE WHEN page_id % 2 = 0 THEN '10.5/P' || page_id % 30 END AS doi, regexp_replace(url, '[?#].*$', '') AS url FROM pages),
u AS (SELECT page_id, coalesce('arxiv:' || arxiv, 'doi:' || lower(doi), 'url:' || lower(url)) AS uid FROM p) SELECT uid, min(page_id) AS page_id, count(*) AS copies FROM u GROUP BY uid""")
def uid_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preprint number, else the DOI, else the address names a record; the first record of a name stays."""
    k = F.col("page_id")
    number = F.when(k % 3 == 0, F.concat(F.lpad((k % 40).cast("string"), 4, "1"), F.lit(".00001")))
    uid = identity.uid(number, F.when(k % 2 == 0, F.concat(F.lit("10.5/P"), k % 30)), F.regexp_replace("url", "[?#].*$", ""))
    return table(spark, sf_dir, "pages").select("page_id", uid.alias("uid")).groupBy("uid").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query("F13 F14 F15 F58", """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://openalex.org/W' || p_partkey WHEN 1 THEN 'W' || p_partkey ELSE 'A' || p_partkey END AS w, CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.1234/AB.' || p_partkey WHEN 1 THEN 'doi: 10.1234/ab.' || p_partkey ELSE 'not a doi' END AS d,
CASE p_partkey % 4 WHEN 0 THEN 'https://arxiv.org/abs/2301.' || lpad(CAST(p_partkey % 99999 AS VARCHAR), 5, '0') || 'v2' WHEN 1 THEN 'arXiv:2301.' || lpad(CAST(p_partkey % 99999 AS VARCHAR), 5, '0') WHEN 2 THEN '10.48550/arXiv.2301.' || lpad(CAST(p_partkey % 99999 AS VARCHAR), 5, '0') ELSE 'cs/0101' END AS a FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'W' || p_partkey ELSE '' END AS work, CASE WHEN p_partkey % 3 < 2 THEN '10.1234/ab.' || p_partkey ELSE '' END AS doi, CASE WHEN p_partkey % 4 < 3 THEN '2301.' || lpad(CAST(p_partkey % 99999 AS VARCHAR), 5, '0') ELSE '' END AS preprint FROM p""")
def bare_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in their several written forms, stripped to the bare one."""
    k = F.col("p_partkey")
    n = F.lpad((k % 99999).cast("string"), 5, "0")
    work = F.when(k % 3 == 0, F.concat(F.lit("https://openalex.org/W"), k)).when(k % 3 == 1, F.concat(F.lit("W"), k)).otherwise(F.concat(F.lit("A"), k))
    doi = F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1234/AB."), k)).when(k % 3 == 1, F.concat(F.lit("doi: 10.1234/ab."), k)).otherwise("not a doi")
    number = F.when(k % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/2301."), n, F.lit("v2"))).when(k % 4 == 1, F.concat(F.lit("arXiv:2301."), n)).when(k % 4 == 2, F.concat(F.lit("10.48550/arXiv.2301."), n)).otherwise("cs/0101")
    return table(spark, sf_dir, "part").select("p_partkey", identity.work_id(work).alias("work"), identity.doi(doi).alias("doi"), identity.preprint_id(number).alias("preprint"))


@query("F05", """SELECT c_custkey, CASE WHEN lower(c_name) IN ('customer#000000007', 'customer#000000012') THEN 100 WHEN contains(lower(n_name), 'nation_1') OR contains(lower(c_mktsegment), 'build') THEN 50 ELSE 0 END AS follow FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def followed_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    score = records.follow_score(F.array("c_name"), F.array("n_name", "c_mktsegment"), ["Customer#000000007", " customer#000000012 "], ["Nation_1", "build"])
    return rows.select("c_custkey", score.alias("follow"))


@query("F34 F37", f"""SELECT doc_id, row_number() OVER (ORDER BY t, doc_id) AS pos FROM (SELECT doc_id, substring(trim(regexp_replace({TITLE_SQL}, '\\p{{C}}', '', 'g'), ' '), 1, 500) AS t FROM documents)""")
def code_point_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitized titles by code point: the JVM's UTF-8 order. Places are counted range by range, not in one window."""
    from lectern.operators.ordinals import sorted_ordinal

    titled = table(spark, sf_dir, "documents").select("doc_id", records.sanitized(title_of(F.col("text"))).alias("t"))
    return sorted_ordinal(titled, ["t", "doc_id"]).select("doc_id", (F.col("ordinal") + 1).alias("pos"))


@query("P19 W21", """SELECT source AS slug, papers, row_number() OVER (ORDER BY papers DESC, source) AS pos FROM (SELECT source, count(*) AS papers FROM documents GROUP BY source) WHERE regexp_matches(source, '^[a-z0-9]+(?:-[a-z0-9]+)*$') AND source NOT IN ('index', 'search', 'themes', 'papers', 'all')""")
def conference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conferences whose slug is usable, the largest first. One row a conference, so one window holds them."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("papers")).where(records.slug_is_valid(F.col("slug")))
    return counts.select("slug", "papers", F.row_number().over(Window.orderBy(F.desc("papers"), "slug")).alias("pos"))


@query("J06", """WITH h AS (SELECT s_suppkey AS hit, s_acctbal AS cites, CASE WHEN s_suppkey % 4 = 0 THEN 'n' || s_suppkey END AS pre, 'title of ' || s_suppkey * 2 AS title FROM supplier),
r AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey % 5000 END AS pre, 'title of ' || c_custkey AS title FROM customer),
rp AS (SELECT pre, min(row) AS row FROM r WHERE pre IS NOT NULL GROUP BY pre HAVING count(*) = 1), rt AS (SELECT title, min(row) AS row FROM r GROUP BY title HAVING count(*) = 1), ht AS (SELECT title FROM h GROUP BY title HAVING count(*) = 1),
m AS (SELECT hit, cites, rp.row, 'preprint' AS matched_by FROM h JOIN rp USING (pre) UNION ALL SELECT hit, cites, rt.row, 'title' FROM h JOIN ht USING (title) JOIN rt USING (title) WHERE NOT coalesce(pre IN (SELECT pre FROM rp), false) AND length(title) >= 8)
SELECT hit, row, matched_by FROM m QUALIFY row_number() OVER (PARTITION BY row ORDER BY cites DESC, hit) = 1""")
def ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits and catalog rows: by preprint number, else by a title unique on both sides; each row once."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    hits = table(spark, sf_dir, "supplier").select(s.alias("hit"), F.col("s_acctbal").alias("cites"), F.when(s % 4 == 0, F.concat(F.lit("n"), s)).alias("preprint"), F.concat(F.lit("title of "), s * 2).alias("title"))
    rows = table(spark, sf_dir, "customer").select(c.alias("row"), F.when(c % 3 == 0, F.concat(F.lit("n"), c % 5000)).alias("preprint"), F.concat(F.lit("title of "), c).alias("title"))
    return matching.match_ranked(hits, rows)


@query("J22 S24", """WITH p AS (SELECT o_orderkey AS id, o_custkey AS t, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey % 7 AS s FROM orders), r AS (SELECT 'k' || c_custkey AS x, c_custkey AS t, 1992 + c_custkey % 8 + g AS y, (c_custkey + g) % 7 AS s, CASE g WHEN 0 THEN 'journals/x/' WHEN 1 THEN 'conf/x/' WHEN 2 THEN 'journals/corr/' ELSE 'conf/y/' END || c_custkey AS key, CASE g WHEN 2 THEN 'CoRR' ELSE 'V' || g END AS venue FROM customer, range(4) t(g)),
m AS (SELECT id, key, venue, CAST(r.y AS INTEGER) AS year FROM p JOIN r USING (t) WHERE lower(venue) <> 'corr' AND r.y BETWEEN p.y - 1 AND p.y + 3 AND (p.s = r.s OR p.s % 2 = 0))
SELECT id, key, venue, year FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY year, CASE WHEN starts_with(key, 'conf/') THEN 0 ELSE 1 END, key) = 1""")
def picked_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues of bibliography records for papers of the same title, near year and a shared surname."""
    def names(s):
        return F.array(F.concat(F.lit("Ann L"), s))

    o, c, g = F.col("o_orderkey"), F.col("c_custkey"), F.col("g")
    authors = F.when(o % 7 % 2 == 0, F.array().cast("array<string>")).otherwise(names(o % 7))
    papers_ = table(spark, sf_dir, "orders").select(o.alias("id"), F.concat(F.lit("t"), F.col("o_custkey")).alias("title"), F.year("o_orderdate").alias("year"), authors.alias("authors"))
    listed = table(spark, sf_dir, "customer").select(c, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g"))
    prefix = F.when(g == 0, "journals/x/").when(g == 1, "conf/x/").when(g == 2, "journals/corr/").otherwise("conf/y/")
    found = listed.select(F.concat(prefix, c).alias("key"), F.concat(F.lit("t"), c).alias("title"), F.when(g == 2, "CoRR").otherwise(F.concat(F.lit("V"), g)).alias("venue"), (F.lit(1992) + c % 8 + g).cast("int").alias("year"), names((c + g) % 7).alias("authors"))
    return matching.pick_venue(papers_, found)


@query("J23 S23", """WITH q AS (SELECT o_orderkey AS id, o_custkey AS citing, o_orderkey % 50 AS d, o_orderkey % 40 AS p, 'works of part number ' || o_orderkey % 200 AS title FROM orders), r AS (SELECT o_custkey AS citing, l_partkey % 50 AS d, CASE WHEN l_linenumber = 1 THEN l_suppkey % 40 END AS p, 'in works of part number ' || l_partkey || ' appeared' AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT id, coalesce(bool_or(coalesce(q.d = r.d AND q.d < 5, false) OR coalesce(q.p = r.p, false) OR coalesce(contains(' ' || text || ' ', ' ' || title || ' '), false)), false) AS listed FROM q LEFT JOIN r USING (citing) GROUP BY id""")
def listed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a paper stands in its citing work's reference list, by DOI, number or title."""
    o = F.col("o_orderkey")
    papers_ = table(spark, sf_dir, "orders").select(o.alias("id"), F.col("o_custkey").alias("citing"), F.when(o % 50 < 5, (o % 50).cast("string")).alias("doi"), (o % 40).cast("string").alias("preprint"), F.concat(F.lit("works of part number "), o % 200).alias("title"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber").join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("citing")), "o_orderkey")
    refs = lines.select("citing", (F.col("l_partkey") % 50).cast("string").alias("doi"), F.when(F.col("l_linenumber") == 1, (F.col("l_suppkey") % 40).cast("string")).alias("preprint"), F.concat(F.lit("in works of part number "), F.col("l_partkey"), F.lit(" appeared")).alias("text"))
    return matching.lists_paper(papers_, refs)


@query("J01 J02 J05", """WITH h AS (SELECT c_custkey, sum(CASE WHEN rn <= n THEN 1 ELSE 0 END) AS h FROM (SELECT o_custkey AS c_custkey, CAST(floor(o_totalprice / 40000) AS BIGINT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 40000) DESC) AS rn FROM orders) GROUP BY 1)
SELECT c_custkey, CAST(coalesce(h, c_nationkey) AS BIGINT) AS h_index FROM customer LEFT JOIN h USING (c_custkey)""")
def author_h_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The h-index of each author's papers, looked up by distinct author; an author without papers keeps its own value."""
    cites = F.floor(F.col("o_totalprice") / 40000)
    ranked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), cites.alias("n"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(cites))).alias("r"))
    found = ranked.groupBy("c_custkey").agg(F.count_if(F.col("r") <= F.col("n")).alias("h_index"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("h_index"))
    return matching.merge_lookup(rows, found, "c_custkey", ["h_index"])


@query("R16 R18 D16", f"""WITH {EDGES_SQL}, l AS (SELECT DISTINCT src, dst, src_year, dst_year - CASE WHEN dst % 4 = 0 THEN 4 ELSE 0 END AS y FROM edges), i AS (SELECT src AS id, count(*) AS citers, count(*) FILTER (WHERE src_year - y > 1) AS inverted, max(src_year - y) AS gap FROM l GROUP BY src HAVING count(*) FILTER (WHERE src_year - y > 1) > 0),
a AS (SELECT id, ['chronology_inversion'] AS reasons, inverted * 2 >= citers AND (inverted >= 2 OR gap >= 3) AS dropped FROM i),
n AS (SELECT id, price >= 400000 AS event, floor(price / 100) AS c, CASE WHEN price >= 300000 AND status = 'P' THEN floor(floor(price / 100) / 10) ELSE floor(price / 100) END AS other, 2001 - yr AS age, id % 7 = 0 AS focus FROM o),
g AS (SELECT *, c > other * 5 AND c - other > 300 AS gap FROM n),
b AS (SELECT id, focus, gap OR (event AND c >= 500) AS dropping, list_filter([CASE WHEN event THEN 'event_title' END, CASE WHEN gap THEN 'count_gap' END, CASE WHEN event AND c >= 500 THEN 'many_citations' END, CASE WHEN NOT (gap OR (event AND c >= 500)) AND age BETWEEN 0 AND 1 AND c >= 1000 * greatest(age, 1) THEN 'young_and_cited' END], lambda x: x IS NOT NULL) AS reasons FROM g),
k AS (SELECT id, reasons, dropping AND NOT focus AS dropped FROM b WHERE dropping OR list_contains(reasons, 'young_and_cited'))
SELECT coalesce(a.id, k.id) AS id, list_concat(coalesce(a.reasons, []), coalesce(k.reasons, [])) AS reasons, coalesce(a.dropped, false) OR coalesce(k.dropped, false) AS dropped FROM a FULL JOIN k ON a.id = k.id""")
def suspect_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that citers predate and records that look merged, as one list."""
    every = nodes(spark, sf_dir)
    year = F.col("yr") - F.when(F.col("id") % 4 == 0, 4).otherwise(0)
    found = matching.chronology_inversions(every.select("id", year.alias("year"), F.col("yr").alias("earliest")), edges(spark, sf_dir))
    inverted = found.select("id", F.array(F.lit("chronology_inversion")).alias("reasons"), "dropped")
    cites = F.floor(F.col("price") / 100)
    title = F.when(F.col("price") >= 400000, "Workshop on things").otherwise("A thing")
    other = F.when((F.col("price") >= 300000) & (F.col("status") == "P"), F.floor(cites / 10)).otherwise(cites)
    nothing = F.lit(None).cast("string")
    told = records.suspect_record(title, nothing, nothing, cites, other, F.lit(2001) - F.col("yr"), F.col("id") % 7 == 0)
    merged = every.select("id", told.alias("t")).where("t is not null").select("id", "t.reasons", (F.col("t.action") == "dropped").alias("dropped"))
    return matching.merge_suspects(inverted, merged)


@query("D06 D10 D11 P21", """WITH p AS (SELECT p_partkey AS id, p_name || ' of the ' || p_type || ' line ' || p_size AS title, CAST(1990 + p_partkey % 3 AS INTEGER) AS year, p_partkey % 50 = 0 AS focus FROM part), s AS (SELECT *, first_value(id) OVER w AS kept, first_value(year) OVER w AS ky FROM p WINDOW w AS (PARTITION BY title ORDER BY focus DESC, year, id)),
m AS (SELECT id AS dropped, kept FROM s WHERE id <> kept AND abs(year - ky) <= 1), e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem),
x AS (SELECT coalesce(a.kept, src) AS src, coalesce(b.kept, dst) AS dst FROM e LEFT JOIN m a ON a.dropped = src LEFT JOIN m b ON b.dropped = dst) SELECT src, dst, true AS kept FROM x WHERE src <> dst GROUP BY ALL""")
def same_title_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one long title and near years are one work; edges move to the work that stays."""
    title = F.concat(F.col("p_name"), F.lit(" of the "), F.col("p_type"), F.lit(" line "), F.col("p_size"))
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title"), (F.lit(1990) + F.col("p_partkey") % 3).cast("int").alias("year"), (F.col("p_partkey") % 50 == 0).alias("is_focus"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit(True).alias("kept"))
    return matching.merge_titles(works, links)[1]


@query("D07 D08", """WITH p AS (SELECT p_partkey AS id, p_brand AS prefix, p_name AS sub, p_size % 4 AS y, p_partkey % 3 AS f, p_partkey % 2 = 0 AS pre, p_partkey % 11 AS d FROM part),
v AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.prefix = b.prefix AND a.f = b.f AND abs(a.y - b.y) <= 1 AND a.pre AND NOT b.pre WHERE (a.d > 5 OR b.d > 5 OR a.d = b.d) AND len(list_intersect(string_split(a.sub, ' '), string_split(b.sub, ' '))) = least(len(list_distinct(string_split(a.sub, ' '))), len(list_distinct(string_split(b.sub, ' '))))),
x AS (SELECT a AS candidate, min(b) AS id FROM v GROUP BY a HAVING count(*) = 1), k AS (SELECT r.id, r.sub || r.prefix AS k, r.y FROM p r WHERE NOT r.pre),
e AS (SELECT c.id AS candidate, min(k.id) AS id FROM p c JOIN k ON k.k = c.sub || c.prefix AND abs(k.y - c.y) <= 1 WHERE c.pre AND k.id <> c.id GROUP BY c.id)
SELECT candidate, id, 'title' AS rule FROM e UNION ALL SELECT candidate, id, 'versioned' FROM x WHERE candidate NOT IN (SELECT candidate FROM e)""")
def resolved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprints that are a registered work: by the same title, else by the only renamed version."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_brand").alias("prefix"), F.split("p_name", " ").alias("subtitle"), (F.col("p_size") % 4).alias("year"), F.array(F.concat(F.lit("F"), k % 3), F.lit("Z Last")).alias("authors"),
        F.when(k % 2 == 0, k.cast("string")).alias("preprint"), F.when(k % 11 <= 5, F.concat(F.lit("10.9/"), k % 11)).otherwise(F.concat(F.lit("10.48550/"), k % 11)).alias("doi"), F.concat("p_name", "p_brand").alias("key"),
    )
    versions = matching.only_versions(rows).select(F.col("a").alias("candidate"), F.col("b").alias("id"))
    registered = rows.where("preprint is null").select("id", "key", "year")
    return matching.resolve_titles(registered, rows.where("preprint is not null").select(F.col("id").alias("candidate"), "key", "year"), versions)


@query("D03 D05 D09", """WITH p AS (SELECT p_partkey AS id, p_partkey // 6 * 6 + CASE WHEN p_partkey % 6 < 4 THEN 0 ELSE 4 END AS c, CAST(floor(p_retailprice) AS BIGINT) AS cites, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '' END AS abstract, CASE WHEN p_partkey % 9 < 2 THEN p_partkey % 9 END AS seed FROM part),
g AS (SELECT c, arg_max(id, (cites, -id)) AS id, arg_max(abstract, (cites, -id)) AS own, arg_min(abstract, id) FILTER (WHERE abstract <> '') AS other, count(*) AS members, count(DISTINCT seed) > 1 AS conflict FROM p GROUP BY c),
a AS (SELECT c, 'a' || id // 2 AS alias FROM p UNION SELECT c, 'b' || id // 6 FROM p WHERE id % 6 IN (1, 2)) SELECT g.id, members, conflict, coalesce(NULLIF(own, ''), other) AS abstract, CAST((SELECT count(*) FROM a WHERE a.c = g.c) AS INTEGER) AS n_aliases FROM g""")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in pairs and fours that share aliases are one work; blanks are filled, conflicting seeds are told."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    rows = part.select(k.alias("id"), F.floor("p_retailprice").alias("cites"), F.when(k % 9 < 2, k % 9).alias("seed"), F.when(k % 5 == 0, F.col("p_name")).otherwise("").alias("abstract"))
    names = F.array_compact(F.array(F.concat(F.lit("a"), F.floor(k / 2)), F.when((k % 6).isin(1, 2), F.concat(F.lit("b"), F.floor(k / 6)))))
    merged = matching.merge_aliases(rows, part.select(k.alias("id"), F.explode(names).alias("alias")), ["abstract"])
    return merged.select("id", "members", "conflict", "abstract", F.size("aliases").alias("n_aliases"))


@query("V14", """WITH f AS (SELECT event_type || '/' || event_id || CASE WHEN event_id % 3 = 0 THEN '.json' ELSE '.txt' END AS name, event_id % 21 = 0 AS broken FROM events) SELECT name, 'unreadable' AS fault FROM f WHERE name LIKE '%.json' AND broken UNION ALL SELECT name, 'forbidden' FROM f WHERE name LIKE 'error/%' UNION ALL SELECT 'manifest.json', 'missing'""")
def release_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a release bundle, one an event: unreadable JSON, forbidden folders, a manifest that is not there."""
    k = F.col("event_id")
    name = F.concat(F.col("event_type"), F.lit("/"), k, F.when(k % 3 == 0, ".json").otherwise(".txt"))
    content = F.when(k % 21 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return matching.bundle_faults(table(spark, sf_dir, "events").select(name.alias("name"), content.alias("content")), ["manifest.json"], ["error/", "tmp/"])


@query("F19 F21 F22", """WITH p AS (SELECT p_partkey, ['José Núñez', 'Ann ' || p_brand] AS a, CASE p_size % 3 WHEN 0 THEN ['J. Nunez'] WHEN 1 THEN ['A. ' || p_brand, 'Zoë Øre'] ELSE ['X Y'] END AS b, p_name FROM part),
s AS (SELECT *, list_transform(a, lambda x: lower(strip_accents(list_last(string_split(x, ' '))))) AS x, list_transform(b, lambda y: lower(strip_accents(list_last(string_split(y, ' '))))) AS y FROM p)
SELECT p_partkey, array_to_string(x, ',') AS surnames, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS overlap, 'on' || regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || 'nets' AS key FROM s""")
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames without marks, their overlap by the smaller list, and title keys without LaTeX."""
    from lectern.functions.unicode import without_marks

    size = F.col("p_size")
    mine = F.array(F.lit("José Núñez"), F.concat(F.lit("Ann "), F.col("p_brand")))
    theirs = F.when(size % 3 == 0, F.array(F.lit("J. Nunez"))).when(size % 3 == 1, F.array(F.concat(F.lit("A. "), F.col("p_brand")), F.lit("Zoë Øre"))).otherwise(F.array(F.lit("X Y")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split(without_marks(F.array_join(mine, "|")), r"\|").alias("a"), F.split(without_marks(F.array_join(theirs, "|")), r"\|").alias("b"))
    title = F.concat(F.lit("On \\emph{"), F.col("p_name"), F.lit("} nets"))
    return rows.select("p_partkey", F.array_join(F.transform("a", text.surname), ",").alias("surnames"), F.round(text.author_overlap(F.col("a"), F.col("b")), 6).alias("overlap"), text.compact_key(records.tidy_latex(title)).alias("key"))


@query("J20 S26", """WITH n AS (SELECT max(o_orderdate) AS now FROM orders), l AS (SELECT o_custkey AS pre, max(o_orderdate) AS last FROM orders GROUP BY 1), h AS (SELECT pre, CASE WHEN c_acctbal > 0 THEN c_name END AS repo, CASE WHEN c_acctbal > 5000 THEN CAST(floor(c_acctbal / 1000) AS BIGINT) ELSE 0 END AS stars, CAST(c_nationkey % 2 AS BIGINT) AS up FROM l JOIN customer ON c_custkey = pre, n WHERE last > now - INTERVAL 200 DAY AND c_acctbal > 0),
b AS (SELECT o_orderkey AS id, h.repo AS r, 'curated-' || n_name AS c, n_name IS NOT NULL AS cur, stars, up FROM orders LEFT JOIN h ON pre = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey)
SELECT id, coalesce(r, c) AS repo, CASE WHEN coalesce(stars, 0) > 0 OR coalesce(up, 0) > 0 THEN stars END AS stars, CASE WHEN coalesce(stars, 0) > 0 OR coalesce(up, 0) > 0 THEN up END AS upvotes, CASE WHEN r IS NOT NULL THEN 'listed' ELSE 'curated' END AS source FROM b WHERE r IS NOT NULL OR cur""")
def code_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of papers: a fresh listing's first, the curated one as fallback."""
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy(F.col("o_custkey").alias("preprint")).agg(F.max("o_orderdate").alias("at"))
    balance = F.col("c_acctbal")
    listed = last.join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "preprint"), "preprint").select(
        "preprint", F.when(balance > 0, F.col("c_name")).alias("repo"), F.when(balance > 5000, F.floor(balance / 1000)).otherwise(0).cast("long").alias("stars"), (F.col("c_nationkey") % 2).cast("long").alias("upvotes"), "at")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    curated = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("preprint"), F.concat(F.lit("curated-"), "n_name").alias("repo"))
    return matching.code_links(orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("preprint")), listed.crossJoin(F.broadcast(now)), curated, F.col("now"), 200)


@query("S19", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'absent' WHEN n IS NULL THEN 'error' ELSE 'ok' END AS status, CAST(CASE WHEN o_orderstatus <> 'P' AND n IS NOT NULL THEN least(n, 3) ELSE 0 END AS INTEGER) AS related FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def fetched_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed works with their references: absent ones, missing lists, and the first three."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("references"))
    works = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("found")).join(lists, "id", "left")
    return matching.related_works(works, 3).select("id", "status", F.size("related").alias("related"))


@query("S22 D20", """WITH n AS (SELECT max(l_shipdate) AS now FROM lineitem), c AS (SELECT l_partkey, count(*) * 50 AS cites, max(l_shipdate) AS last FROM lineitem GROUP BY 1), f AS (SELECT l_partkey, cites FROM c, n WHERE last > now - INTERVAL 300 DAY)
SELECT p_partkey AS id, CAST(CASE WHEN coalesce(cites > floor(p_retailprice), false) THEN cites ELSE floor(p_retailprice) END AS BIGINT) AS cites, CASE WHEN coalesce(cites > floor(p_retailprice), false) THEN 'semantic_scholar' ELSE 'openalex' END AS cites_from FROM part LEFT JOIN f ON l_partkey = p_partkey""")
def fresh_citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of a work's own count and a cached one that is not too old."""
    lines = table(spark, sf_dir, "lineitem")
    cache = lines.groupBy(F.col("l_partkey").alias("id")).agg((F.count("*") * 50).alias("cites"), F.max("l_shipdate").alias("at"))
    now = lines.agg(F.max("l_shipdate").alias("now"))
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor("p_retailprice").cast("long").alias("cites"))
    return matching.fresh_counts(works, cache.crossJoin(F.broadcast(now)), F.col("now"), 300)


@query("S21", """WITH n AS (SELECT max(l_shipdate) AS now FROM lineitem), e AS (SELECT l_orderkey % 500 AS citing, l_suppkey AS cited, l_shipdate AS shipped, l_orderkey, l_linenumber, l_returnflag FROM lineitem, n WHERE l_shipdate > now - INTERVAL 900 DAY),
k AS (SELECT citing, cited, max(struct_pack(a := shipped, b := l_orderkey, c := l_linenumber, d := l_returnflag)) AS m, bool_or(l_returnflag = 'R') AS influential FROM e GROUP BY ALL)
SELECT citing, cited, CAST(CASE WHEN m.d = 'N' THEN 0 ELSE 1 END AS INTEGER) AS contexts, influential FROM k""")
def fetched_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citing pairs of a paged fetch, one each, with what their contexts say; stale entries count as absent."""
    lines = table(spark, sf_dir, "lineitem")
    now = lines.agg(F.max("l_shipdate").alias("now"))
    flag = F.col("l_returnflag")
    fetched = lines.crossJoin(F.broadcast(now)).where(F.col("l_shipdate") > F.col("now") - F.make_interval(days=F.lit(900))).select(
        (F.col("l_orderkey") % 500).alias("citing"), F.col("l_suppkey").alias("cited"), F.when(flag == "N", F.array(F.lit(" "))).otherwise(F.array(F.lit("We use it."), F.lit(""))).alias("contexts"), F.array(F.lit("background")).alias("intents"),
        (flag == "R").alias("influential"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", flag).alias("order"), F.col("l_shipdate").alias("at"), "now")
    last = fetched.groupBy("citing", "cited").agg(F.max_by(F.struct("contexts", "intents", "at", "now"), "order").alias("l"), F.bool_or("influential").alias("influential"))
    one = last.select("citing", "cited", "l.contexts", "l.intents", "influential", "l.at", "l.now")
    return matching.usable_references(one, F.col("now"), 900).select("citing", "cited", F.size("contexts").alias("contexts"), "influential")
