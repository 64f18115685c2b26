"""Scalar function queries: each applies a family of text columns to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import highlight, text
from lectern.operators.inverted import inverted_indexes
from lectern.plans.registry import query
from lectern.plans.views import PAPERS_SQL, TITLE_SQL, papers, table, title_of

_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query("F25", """SELECT doc_id, CASE WHEN length(text) <= 320 THEN text ELSE regexp_replace(substring(text, 1, 320), '\\s+\\S*$', '') || '…' END AS preview FROM documents""")
def preview_320(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.abstract_preview(F.col("text")).alias("preview"))


@query("F27 F28 K01 K11", """SELECT conv_id, turn, CASE WHEN regexp_matches(cell, '^[=+\\-@\\t\\r]') THEN '''' || cell ELSE cell END AS guarded, cell IS NOT NULL AS undone
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' ELSE '' END || text AS cell FROM conversations)""")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.when(F.col("turn") % 3 == 0, "=").otherwise(""), F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", cell.alias("cell"), text.formula_guard(cell).alias("guarded"))
    return rows.select("conv_id", "turn", "guarded", F.coalesce(text.formula_unguard(F.col("guarded")) == F.col("cell"), F.lit(False)).alias("undone"))


@query("F20", f"""WITH {PAPERS_SQL}, c AS (SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS k, {_TOKENS.format('title')} AS w, ord FROM papers),
t AS (SELECT min(ord) AS id, k, any_value(w ORDER BY ord) AS w, count(*) AS n FROM c WHERE k <> '' GROUP BY k)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS score FROM t a JOIN t b ON a.id < b.id AND list_has_any(a.w, b.w) WHERE 5 * len(list_intersect(a.w, b.w)) >= 3 * len(list_distinct(list_concat(a.w, b.w)))""")
def near_title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct titles, each named by its least paper, that share three fifths of their words."""
    from lectern.operators.matching import similar_sets

    titled = papers(spark, sf_dir).select("ord", text.compact_key(F.col("title")).alias("k"), text.tokens(F.col("title")).alias("w")).where("k <> ''")
    distinct = titled.groupBy("k").agg(F.min_by("w", "ord").alias("items"), F.min("ord").alias("id"))
    return similar_sets(distinct.select("id", "items"), 3, 5).select("a", "b", F.round("score", 6).alias("score"))


@query("D14 D12 F53", """SELECT p_partkey, substr(sha256('lectern:v1:part:' || p_partkey), 1, 40) AS paper_id, substr(sha256('lectern:v1:part:' || p_partkey), 1, 2) AS shard FROM part""")
def stable_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.identity import stable_id

    paper = stable_id(F.lit("part"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", paper.alias("paper_id"), F.substring(paper, 1, 2).alias("shard"))


@query("D12 D13", """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_replace(host, '^(www|m|blog)\\.', '') AS source, regexp_extract(path, '^([a-z]{2})/([0-9]+)', 1) AS lang, regexp_extract(path, '^([a-z]{2})/([0-9]+)', 2) AS source_id,
  substr(sha256('lectern:v1:' || regexp_replace(host, '^(www|m|blog)\\.', '') || ':' || regexp_extract(path, '^([a-z]{2})/([0-9]+)', 2)), 1, 40) AS paper_id FROM u""")
def identity_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.identity import stable_id, url_host, url_path

    host, path = F.regexp_replace(url_host(F.col("url")), r"^(www|m|blog)\.", ""), url_path(F.col("url"))
    number = F.regexp_extract(path, "^([a-z]{2})/([0-9]+)", 2)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("source"), F.regexp_extract(path, "^([a-z]{2})/([0-9]+)", 1).alias("lang"), number.alias("source_id"), stable_id(host, number).alias("paper_id"))


@query("F26 F47 F49 F60", """SELECT event_id, CAST(CASE WHEN regexp_matches(trim(x), '^[+-]?[0-9]{1,18}(\\.[0-9]*)?$') THEN regexp_extract(trim(x), '^([+-]?[0-9]{1,18})', 1) END AS BIGINT) AS whole,
CASE WHEN y BETWEEN 1900 AND 2100 THEN CAST(y AS VARCHAR) ELSE 'unknown' END AS bucket, CASE WHEN d <= 0 THEN 'today' WHEN d < 30 THEN d || 'd' WHEN d < 365 THEN CAST(floor(d / 30) AS BIGINT) || 'mo' ELSE CAST(floor(d / 365) AS BIGINT) || 'y' END AS age, d * 60000 + 5000 AS ms
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(round(value, 2) AS VARCHAR) WHEN 1 THEN ' ' || user_id || ' ' WHEN 2 THEN 'n/a' ELSE '' END AS x, 1850 + event_id % 400 AS y, event_id % 800 AS d FROM events)""")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    cell = F.when(n % 4 == 0, F.round("value", 2).cast("string")).when(n % 4 == 1, F.concat(F.lit(" "), F.col("user_id"), F.lit(" "))).when(n % 4 == 2, "n/a").otherwise("")
    minutes = F.concat((n % 800).cast("string"), F.lit("m5s"))
    return table(spark, sf_dir, "events").select("event_id", text.lenient_int(cell).alias("whole"), text.year_bucket(1850 + n % 400).alias("bucket"), text.age_text(n % 800).alias("age"), text.duration_ms(minutes).alias("ms"))


@query("F11", """SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS decoded FROM documents WHERE length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) > 0""")
def inverted_index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts are inverted to maps from word to positions and decoded again."""
    words = text.collapse(F.col("text"))
    indexed = inverted_indexes(table(spark, sf_dir, "documents").where(F.char_length(words) > 0).select("doc_id", words.alias("text")))
    return indexed.select("doc_id", text.decode_inverted_index(F.col("index")).alias("decoded"))


@query("F29 G01 F30", f"""WITH {PAPERS_SQL}, t AS (SELECT ord, source, unnest(CASE WHEN len(tags) = 0 THEN ['Other'] ELSE tags END) AS tag FROM (SELECT ord, source, list_filter([
  CASE WHEN regexp_matches(lower(abstract), '\\bthe(?:re|m)\\w*') THEN 'There' END, CASE WHEN regexp_matches(lower(abstract), 'licen[sc]e') THEN 'Licence' END,
  CASE WHEN regexp_matches(lower(abstract), '\\b(?:der|und)\\b') THEN 'German' END, CASE WHEN regexp_matches(lower(abstract), '!!|\\$\\$\\$') THEN 'Noise' END], lambda x: x IS NOT NULL) AS tags FROM papers))
SELECT source, tag, count(*) AS n, min(ord) AS first FROM t GROUP BY source, tag QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(ord), tag) <= 6""")
def tag_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.rules import matched_tags, or_default
    from lectern.operators.windows import first_by

    rules = [("There", [r"\bthe(?:re|m)\w*"]), ("Licence", ["licen[sc]e"]), ("German", [r"\b(?:der|und)\b"]), ("Noise", ["!!", r"\$\$\$"])]
    low = papers(spark, sf_dir).select("ord", "source", F.lower(text.strip_zero_width(F.col("abstract"))).alias("low"))
    found = low.select("ord", "source", matched_tags(F.col("low"), rules).alias("found"))
    exploded = found.select("ord", "source", F.explode(or_default(F.col("found"))).alias("tag"))
    counts = exploded.groupBy("source", "tag").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return first_by(counts, ["source"], [F.desc("n"), F.asc("first"), F.asc("tag")], 6)


@query("F36 F42 F39", f"""SELECT doc_id, regexp_replace(substring(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '-+$', '') AS slug,
regexp_replace(t, '([&%$#_{{}}])', '\\\\\\1', 'g') AS escaped, CASE WHEN length(w) >= 5 AND w LIKE '%es' THEN [w, regexp_replace(w, 's$', ''), regexp_replace(w, 'es$', '')] WHEN length(w) >= 5 AND w LIKE '%s' THEN [w, regexp_replace(w, 's$', '')] ELSE [w] END AS variants
FROM (SELECT doc_id, {TITLE_SQL} AS t, lower(string_split({TITLE_SQL}, ' ')[1]) AS w FROM documents)""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = table(spark, sf_dir, "documents").select("doc_id", title_of(F.col("text")).alias("t"))
    return titled.select("doc_id", text.slug(F.col("t")).alias("slug"), text.bibtex_escape(F.col("t")).alias("escaped"), text.term_variants(F.lower(F.substring_index("t", " ", 1))).alias("variants"))


@query("F52 S09 S10 S11 S15", """SELECT page_id, trim(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS heading, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""")
def listing_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.collapse(F.regexp_extract(html, "<h1[^>]*>([^<]*)", 1)).alias("heading"), F.regexp_count(html, F.lit("<p[ >]")).cast("long").alias("paragraphs"),
        F.size(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"),
    )


@query("D18")
def single_word_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles, each named by its least part, that differ in one long word at any place; tested against a plain
    version."""
    from lectern.operators.matching import typo_pairs

    v = F.col("p_partkey")
    name = F.concat_ws(" ", F.col("p_name"), F.when(v % 3 == 0, "standart").when(v % 3 == 1, "standard").otherwise("measured"), F.col("p_type"), F.lit("series"))
    return typo_pairs(table(spark, sf_dir, "part").select(v.alias("id"), name.alias("title")))


@query("F12", """SELECT o_orderkey, CASE WHEN m BETWEEN 1 AND 12 THEN CASE WHEN yy >= 91 THEN 1900 + yy ELSE 2000 + yy END END AS id_year, CASE WHEN yr - (1990 + o_orderkey % 10) >= 3 THEN 1990 + o_orderkey % 10 END AS trusted
FROM (SELECT o_orderkey, year(o_orderdate) AS yr, CAST(substr(x, 1, 2) AS INTEGER) AS yy, CAST(substr(x, 3, 2) AS INTEGER) AS m FROM (SELECT *, strftime(o_orderdate, '%y') || lpad(CAST(o_orderkey % 15 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS x FROM orders))""")
def record_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.identity import id_year, trustworthy_year

    key = F.col("o_orderkey")
    code = F.concat(F.date_format("o_orderdate", "yy"), F.lpad((key % 15).cast("string"), 2, "0"), F.lit("."), F.lpad((key % 100000).cast("string"), 5, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", id_year(code).alias("id_year"), trustworthy_year(F.year("o_orderdate"), 1990 + key % 10).alias("trusted"))


@query("F35 F38 F18")
def unicode_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms and marks need Python's tables: an Arrow function, tested against unicodedata."""
    from lectern.functions.unicode import fuzzy_title

    return table(spark, sf_dir, "documents").select("doc_id", fuzzy_title(title_of(F.col("text"))).alias("key"))


@query("F33")
def exact_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-even on the exact binary value, as the exporters print scores."""
    from lectern.functions.unicode import round_exact

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", round_exact(F.col("l_extendedprice") * F.col("l_discount"), F.lit(2)).alias("amount"))


@query("F51")
def unescaped_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.unicode import html_unescape

    return table(spark, sf_dir, "pages").select("page_id", html_unescape(F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1)).alias("heading"))


@query("F31", f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower({TITLE_SQL}), '[a-z0-9]+'), lambda w: length(w) >= 5)) AS w, lower(text) AS body FROM documents)
SELECT doc_id, len(w) >= 3 AND len(list_filter(w, lambda x: contains(substr(body, 200), substr(x, 1, 5)))) = 0 AS contradicts FROM t""")
def abstract_contradicts_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(text.tokens(title_of(F.col("text"))), lambda w: F.char_length(w) >= 5)
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), F.lower(F.substring("text", 200, 2147483647)).alias("body"))
    return rows.select("doc_id", ((F.size("w") >= 3) & ~F.exists("w", lambda x: F.contains(F.col("body"), F.substring(x, 1, 5)))).alias("contradicts"))


@query("F45", """SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)(?:tion|der|en)')) AS hits, sha256(text) AS whole FROM conversations WHERE text IS NOT NULL""")
def highlighted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments put together again are the text."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", highlight.highlight_segments(F.col("text"), ["en", "tion", "der"]).alias("s"))
    whole = F.array_join(F.transform("s", lambda x: x["segment"]), "")
    return rows.select("conv_id", "turn", F.size(F.filter("s", lambda x: x["hit"])).cast("long").alias("hits"), F.sha2(whole.cast("binary"), 256).alias("whole"))


@query("F44", r"""WITH x AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents) SELECT doc_id, p > 120 AS cut, sha256(CASE WHEN p > 120 THEN substr(text, CAST(p - length(regexp_extract(substr(text, 1, CAST(p - 1 AS BIGINT)), '(\S+\s+)$', 1)) AS BIGINT)) ELSE text END) AS view FROM x""")
def snippet_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = highlight.abstract_view(F.col("text"), "license")
    return table(spark, sf_dir, "documents").select("doc_id", view.alias("v")).select("doc_id", F.col("v.leading").alias("cut"), F.sha2(F.col("v.view").cast("binary"), 256).alias("view"))


@query("F56", """SELECT l_orderkey, l_linenumber, l_partkey, 2 + greatest(l_suppkey % 5 + 1, 1) + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS targets FROM lineitem""")
def citation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = (F.col("l_suppkey") % 5 + 3).cast("string")
    sentence = F.concat(F.lit("As shown in [1, 2] and ["), F.lit("3-"), last, F.lit("]"), F.when(F.col("l_quantity") > 25, " by Lee et al., 2019").otherwise(""), F.lit("."))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", highlight.citation_targets(sentence).cast("long").alias("targets"))


@query("F41 F61 F24 P11", """WITH t AS (SELECT p_partkey, p_name, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part)
SELECT p_partkey, p_partkey % 7 = 0 AS japanese, len(list_filter(w, lambda x: CASE WHEN length(x) > 5 THEN regexp_replace(x, '(?:ization|isation|ations?|ings?|ers?|ed|es|s)$', '') ELSE x END = 'widget')) > 0 AS stem,
CASE WHEN list_contains(w, 'red') AND list_contains(w, 'widget') THEN abs(list_position(w, 'red') - list_position(w, 'widget')) END AS apart, list_contains(w, 'red') AND list_contains(w, 'widget') AS relevant FROM t""")
def query_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    asked = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("拡散モデルの研究 "), F.substring(name, 1, 3))).otherwise(name)
    return table(spark, sf_dir, "part").select(
        "p_partkey", highlight.is_japanese(asked).alias("japanese"), highlight.stem_contains(name, "widgets").alias("stem"),
        highlight.token_distance(words, "red", "widget").cast("long").alias("apart"), highlight.topic_relevant(F.lit(""), "red widget", title=name).alias("relevant"))


@query("C19 F54", """SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, '|' ORDER BY o_orderkey)) AS fingerprint, avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END) AS template_ratio,
CASE WHEN avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END) < 0.3 THEN 'good' WHEN avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END) < 0.7 THEN 'mixed' ELSE 'poor' END AS tier FROM orders GROUP BY o_custkey""")
def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.rules import quality_tier

    ratio = F.avg(F.when(F.col("o_orderpriority") == "5-LOW", 1.0).otherwise(0.0))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(rows, "|").cast("binary"), 256).alias("fingerprint"), ratio.alias("template_ratio"), quality_tier(ratio).alias("tier"))
