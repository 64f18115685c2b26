"""Matching and merging of literature records as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.records import title_key, years_compatible
from lectern.functions.text import surname
from lectern.plans.storage import materialize, spread


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key no other row has."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return rows.join(counts, key)


def match_ranked(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """(hit, row, matched_by) of hits(hit, cites, preprint, title) and rows(row, preprint, title).

    The preprint number decides first, where one row has it; else the title (eight characters at least), where one hit
    and one row have it. Hits come by citations, then id; a row that several hits claim goes to the first.
    """
    by_number = hits.join(unique_keys(rows.select("row", "preprint"), "preprint"), "preprint").select("hit", "cites", "row", F.lit("preprint").alias("matched_by"))
    long = rows.where(F.char_length("title") >= 8).select("row", "title")
    left = unique_keys(hits, "title").join(by_number.select("hit"), "hit", "left_anti")
    by_title = left.join(unique_keys(long, "title"), "title").select("hit", "cites", "row", F.lit("title").alias("matched_by"))
    first = Window.partitionBy("row").orderBy(F.desc("cites"), "hit")
    return by_number.unionByName(by_title).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("hit", "row", "matched_by")


def pick_venue(papers: DataFrame, records: DataFrame) -> DataFrame:
    """(id, key, venue, year) of papers(id, title, year, authors) and records(key, title, venue, year, authors).

    A record's title is the paper's, its year lies from one before to three after, a surname is shared (if the paper has
    any) and its venue is no preprint server; of several the earliest, conference papers first, then by key.
    """
    usable = records.where(F.coalesce("venue", F.lit("")) != "").where((F.lower("venue") != "corr") & ~F.startswith("key", F.lit("journals/corr/")))
    right = usable.select("key", F.col("title").alias("t"), "venue", F.col("year").alias("y"), F.transform("authors", surname).alias("theirs"))
    left = papers.select("id", "title", "year", F.transform("authors", surname).alias("mine")).where("title <> ''")
    near = left.join(right, F.col("title") == F.col("t")).where(
        F.coalesce(F.col("y").between(F.col("year") - 1, F.col("year") + 3), F.lit(True)) & ((F.size("mine") == 0) | F.arrays_overlap("mine", "theirs")))
    order = Window.partitionBy("id").orderBy(F.coalesce("y", F.lit(9999)), F.desc(F.startswith("key", F.lit("conf/"))), "key")
    return near.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("id", "key", "venue", F.col("y").alias("year"))


def lists_paper(papers: DataFrame, references: DataFrame) -> DataFrame:
    """(id, listed) of papers(id, citing, doi, preprint, title) and references(citing, doi, preprint, text): by DOI, by
    preprint number, or by a title of four words that stands in a reference as whole words. Normalised texts."""
    r = references.select("citing", F.col("doi").alias("r_doi"), F.col("preprint").alias("r_preprint"), "text")
    titled = (F.size(F.split("title", " ")) >= 4) & F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), "title", F.lit(" ")))
    same = F.coalesce(F.col("doi") == F.col("r_doi"), F.lit(False)) | F.coalesce(F.col("preprint") == F.col("r_preprint"), F.lit(False)) | F.coalesce(titled, F.lit(False))
    return papers.join(r, "citing", "left").groupBy("id").agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("listed"))


def merge_lookup(rows: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of a lookup; where it has no row or no value, they keep their own."""
    right = found.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(right, key, "left").select(*kept)


def merge_titles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merged) of nodes(id, title, year, is_focus) and edges(src, dst, …).

    Nodes of one title key merge into the focus node, else the earliest, else that of the least id, if their years are
    compatible with its. Edges move along, loops go, and of edges with the same ends an own one wins over a moved one.
    """
    keyed = nodes.select("id", title_key(F.col("title")).alias("key"), "year", "is_focus").where("key is not null")
    first = Window.partitionBy("key").orderBy(F.desc_nulls_last("is_focus"), F.asc_nulls_last("year"), "id")
    survivor = keyed.withColumns({"kept": F.first("id").over(first), "kept_year": F.first("year").over(first)})
    merged = survivor.where((F.col("id") != F.col("kept")) & years_compatible(F.col("year"), F.col("kept_year"))).select(F.col("id").alias("dropped"), "kept")
    moved = edges
    for end in ("src", "dst"):
        names = merged.select(F.col("dropped").alias(end), F.col("kept").alias(f"_{end}"))
        moved = moved.join(names, end, "left")
    own = F.col("_src").isNull() & F.col("_dst").isNull()
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = moved.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), *rest, own.alias("_own")).where("src <> dst")
    best = ends.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), F.struct("_own", *(F.col(c) for c in rest))).alias("_e"))
    return nodes.join(merged.select(F.col("dropped").alias("id")), "id", "left_anti"), best.select("src", "dst", *(F.col(f"_e.{c}") for c in rest)), merged


def versioned_pairs(papers: DataFrame) -> DataFrame:
    """(a, b) of papers(id, prefix, subtitle, year, authors, preprint, doi): the preprint and the renamed venue version.

    Same name before the colon and same first author; years at most one apart; the shorter subtitle's words and the
    smaller list of two surnames at least are within the other's; one of them has a preprint number; venue DOIs agree.
    """
    own = papers.select("id", "prefix", "subtitle", "year", F.transform("authors", surname).alias("names"), "preprint", F.when(~F.startswith("doi", F.lit("10.48550/")), F.col("doi")).alias("venue_doi"))
    keyed = own.withColumn("first", F.get("names", F.lit(0))).where("prefix is not null and first is not null and size(subtitle) > 0 and size(names) >= 2")
    a = keyed.where("preprint is not null").select("prefix", "first", *(F.col(c).alias(f"a_{c}") for c in ("id", "subtitle", "year", "names", "venue_doi")))
    b = keyed.where("preprint is null").select("prefix", "first", *(F.col(c).alias(f"b_{c}") for c in ("id", "subtitle", "year", "names", "venue_doi")))

    def within(name: str) -> Column:
        x, y = F.col(f"a_{name}"), F.col(f"b_{name}")
        return F.size(F.array_intersect(x, y)) == F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))

    near = spread(a, "prefix", "first").join(b, ["prefix", "first"]).where(F.abs(F.col("a_year") - F.col("b_year")) <= 1)
    same_doi = F.coalesce(F.col("a_venue_doi") == F.col("b_venue_doi"), F.lit(True))
    return near.where(within("subtitle") & within("names") & same_doi).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def only_versions(papers: DataFrame) -> DataFrame:
    """(a, b): the ``versioned_pairs`` of papers whose preprint has no other. Papers that agree in all that is compared meet as
    one, with their least and largest ids."""
    same = ["prefix", "subtitle", "year", "authors", "venue"]
    kinds = papers.withColumns({"venue": F.when(~F.startswith("doi", F.lit("10.48550/")), F.col("doi")), "pre": F.col("preprint").isNotNull()})
    kinds = materialize(kinds.groupBy(*same, "pre").agg(F.min("id").alias("kind"), F.max("id").alias("last")), "version-kinds")
    stand = kinds.select(F.col("kind").alias("id"), "prefix", "subtitle", "year", "authors", F.when(F.col("pre"), "").alias("preprint"), F.col("venue").alias("doi"))
    venue = kinds.select(F.col("kind").alias("b"), "last")
    found = versioned_pairs(stand).join(venue, "b").groupBy("a").agg(F.min("b").alias("b"), F.max("last").alias("last")).where("b = last").drop("last")
    own = papers.where("preprint is not null").withColumn("venue", F.when(~F.startswith("doi", F.lit("10.48550/")), F.col("doi"))).select("id", *same)
    kind = found.join(kinds.where("pre").select(F.col("kind").alias("a"), *(F.col(c).alias(f"_{c}") for c in same)), "a").drop("a")
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(kind, agree).select(F.col("id").alias("a"), "b")


def resolve_titles(registered: DataFrame, candidates: DataFrame, versioned: DataFrame) -> DataFrame:
    """(candidate, id, rule): of candidates(candidate, key, year) the registered(id, key, year) node that is the same work.

    The first node of the same title key with a compatible year; else the versioned(candidate, id) match, if it is the
    only one.
    """
    least = Window.partitionBy("key", "y").orderBy("id")
    known = registered.select("key", F.col("year").alias("y"), "id").distinct().withColumn("_r", F.row_number().over(least)).where("_r <= 2").drop("_r")  # the second, where the first is the candidate
    exact = candidates.join(known, "key").where(years_compatible(F.col("year"), F.col("y")) & (F.col("candidate") != F.col("id")))
    by_title = exact.groupBy("candidate").agg(F.min("id").alias("id")).select("candidate", "id", F.lit("title").alias("rule"))
    only = versioned.groupBy("candidate").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1")
    by_version = only.join(by_title.select("candidate"), "candidate", "left_anti").select("candidate", "id", F.lit("versioned").alias("rule"))
    return by_title.unionByName(by_version)


def merge_suspects(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, reasons, dropped) of two lists: reasons of both, dropped if either says so."""
    both = a.withColumn("_o", F.lit(0)).unionByName(b.withColumn("_o", F.lit(1)))
    return both.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "reasons"))), lambda x: x["reasons"])).alias("reasons"), F.bool_or("dropped").alias("dropped"))


def chronology_inversions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, inverted, citers, gap, dropped) of nodes(id, year, earliest) cited by works two years older or more."""
    links = edges.where("src <> dst").select("src", "dst").distinct()
    cited = links.join(nodes.select(F.col("id").alias("src"), "earliest"), "src").join(nodes.select(F.col("id").alias("dst"), "year"), "dst")
    gap = F.col("earliest") - F.col("year")
    by = cited.where("earliest is not null and year is not null").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("citers"), F.count_if(gap > 1).alias("inverted"), F.max(gap).alias("gap"))
    return by.where("inverted > 0").select("id", "inverted", "citers", "gap", ((F.col("inverted") * 2 >= F.col("citers")) & ((F.col("inverted") >= 2) | (F.col("gap") >= 3))).alias("dropped"))


def merge_aliases(rows: DataFrame, aliases: DataFrame, fill: list[str]) -> DataFrame:
    """One row for each set of rows(id, cites, seed, …) that aliases(id, alias) join: the member of most citations, then of
    least id, survives; its blank fields are filled from the first member that has them; all aliases go along. Different
    seeds in one set are a conflict, which is told and not resolved.
    """
    from lectern.operators.dedup import components_by_key

    parts = components_by_key(aliases, "id", "alias").withColumnsRenamed({"node": "id"})
    member = rows.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = aliases.join(parts, "id").groupBy("component").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))

    def first(c: str) -> Column:
        value = F.nullif(F.col(c), F.lit(""))
        return F.min_by(value, F.when(value.isNotNull(), F.col("id"))).alias(f"_{c}")

    merged = member.groupBy("component").agg(
        F.max_by(F.struct("id", *fill), F.struct("cites", -F.col("id"))).alias("s"), F.count("*").alias("members"), (F.countDistinct("seed") > 1).alias("conflict"), *(first(c) for c in fill))
    filled = [F.coalesce(F.nullif(F.col(f"s.{c}"), F.lit("")), F.col(f"_{c}")).alias(c) for c in fill]
    return merged.join(names, "component", "left").select(F.col("s.id").alias("id"), "members", "conflict", *filled, F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def bundle_faults(files: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """(name, fault) of a release's files(name, content): required ones that are missing, JSON that can't be read, and names
    under a forbidden prefix."""
    spark = files.sparkSession
    missing = spark.createDataFrame([(n,) for n in required], "name string").join(files.select("name"), "name", "left_anti").select("name", F.lit("missing").alias("fault"))
    broken = files.where(F.endswith("name", F.lit(".json")) & F.expr("try_parse_json(content)").isNull()).select("name", F.lit("unreadable").alias("fault"))
    barred = files.where(F.regexp("name", F.lit("^(?:" + "|".join(forbidden) + ")"))).select("name", F.lit("forbidden").alias("fault"))
    return missing.unionByName(broken).unionByName(barred)


def code_links(nodes: DataFrame, listed: DataFrame, curated: DataFrame, now: Column, days: int) -> DataFrame:
    """(id, repo, stars, upvotes, source) of nodes(id, preprint): the listed(preprint, repo, stars, upvotes, at) repository,
    if its entry is fresh, else the curated(preprint, repo) one. Stars and upvotes stay only if one is above zero."""
    fresh = listed.where((F.col("at") > now - F.make_interval(days=F.lit(days))) & F.col("repo").isNotNull()).select("preprint", F.col("repo").alias("_r"), "stars", "upvotes")
    both = nodes.join(fresh, "preprint", "left").join(curated.select("preprint", F.col("repo").alias("_c")), "preprint", "left")
    some = (F.coalesce("stars", F.lit(0)) > 0) | (F.coalesce("upvotes", F.lit(0)) > 0)
    source = F.when(F.col("_r").isNotNull(), "listed").when(F.col("_c").isNotNull(), "curated")
    return both.where(source.isNotNull()).select("id", F.coalesce("_r", "_c").alias("repo"), *(F.when(some, F.coalesce(c, F.lit(0))).alias(c) for c in ("stars", "upvotes")), source.alias("source"))


def related_works(works: DataFrame, limit: int) -> DataFrame:
    """(id, status, related) of works(id, found, references): an absent work gives none, a missing list is an error, else
    the first ``limit`` references."""
    status = F.when(~F.col("found"), "absent").when(F.col("references").isNull(), "error").otherwise("ok")
    return works.select("id", status.alias("status"), F.when(status == "ok", F.slice("references", 1, limit)).otherwise(F.array().cast(works.schema["references"].dataType)).alias("related"))


def fresh_counts(nodes: DataFrame, cache: DataFrame, now: Column, days: int) -> DataFrame:
    """(id, cites, cites_from) of nodes(id, cites) and cache(id, cites, at): the larger count with its source; entries
    older than ``days`` count as absent."""
    live = cache.where(F.col("at") > now - F.make_interval(days=F.lit(days))).select("id", F.col("cites").alias("_c"))
    larger = F.coalesce(F.col("_c") > F.col("cites"), F.lit(False))
    return nodes.join(live, "id", "left").select("id", F.when(larger, F.col("_c")).otherwise(F.greatest("cites", F.lit(0))).alias("cites"), F.when(larger, "semantic_scholar").otherwise("openalex").alias("cites_from"))


def usable_references(edges: DataFrame, now: Column, days: int) -> DataFrame:
    """Fetched edges(citing, cited, contexts, intents, influential, at) that are fresh, one a pair: the latest, with contexts
    that say something, and influence where any fetch told it."""
    fresh = edges.where(F.col("at") > now - F.make_interval(days=F.lit(days)))
    last = fresh.groupBy("citing", "cited").agg(F.max_by(F.struct("contexts", "intents"), "at").alias("l"), F.bool_or("influential").alias("influential"))
    return last.select("citing", "cited", F.filter("l.contexts", lambda c: F.trim(c) != "").alias("contexts"), "l.intents", "influential")
