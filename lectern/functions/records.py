"""Columns that judge a literature record: venue, kind, identity, year and order. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.rules import any_of, ascii_boundaries
from lectern.functions.text import collapse, compact_key, jaccard, surname, titles_diverge

# Venues by tier, and phrases that announce one.
TIERS = ((1, 100, ("NEURIPS", "NIPS", "ICML", "ICLR")), (2, 80, ("AAAI", "CVPR", "ACL", "EMNLP")), (3, 60, ("AISTATS", "NAACL", "ECCV", "ICCV", "IJCAI", "KDD", "WWW")))
ACCEPTED = r"(?i)(?<![0-9A-Za-z_])(?:accepted (?:at|to|by)|to appear (?:at|in)|published (?:at|in))\s+(?:the\s+)?([A-Za-z]+)"
WORKSHOP = r"(?i)\bworkshop\b"
DECISION = r"(?i)(?<![0-9A-Za-z_])(oral|spotlightposter|spotlight|poster)(?![0-9A-Za-z_])"
REVIEW_VENUE = r"(?i)\b(?:computing\s+surveys|surveys\s+(?:and|&)\s+tutorials|signal\s+processing\s+magazine|foundations\s+and\s+trends|annual\s+reviews?\s+of|nature\s+reviews|physics\s+reports|artificial\s+intelligence\s+review)\b"
SURVEY_TITLES = [
    r"(?i)\b(?:surveys?|reviews?(?!-)|overview|tutorial|primer|literature\s+review|systematic\s+review|introduction\s+to|perspectives?\s+(?:on|of|for))\b",
    r"(?i)\b(?:a\s+comprehensive\b|recent\s+(?:advances|progress|developments|trends)\b|challenges\s+and\s+opportunities\b|opportunities\s+and\s+challenges\b|state[\s-]of[\s-]the[\s-]art\s+(?:and|in|on|of|review|survey)\b)",
    r"(?i)^(?:an?\s+)?(?:comprehensive\s+|brief\s+|short\s+|recent\s+)?(?:survey|review|tutorial|overview|perspective|roadmap|primer)(?![0-9A-Za-z_])(?!-)",
    r"(?i):\s*(?:an?\s+|the\s+)?(?:survey|review|tutorial|overview|perspective|roadmap|primer|state[\s-]of[\s-]the[\s-]art)\b",
]
SURVEY_ABSTRACTS = [
    r"(?i)\bwe\s+(?:comprehensively\s+|systematically\s+|critically\s+|extensively\s+)?review(?![0-9A-Za-z_])(?!\s+(?:the\s+)?(?:related|background|prior\s+work\s+in))",
    r"(?i)\b(?:in\s+)?this\s+(?:review|survey|tutorial|overview)\b",
    r"(?i)\b(?:in\s+)?this\s+(?:article|paper|work|chapter)\s+(?:we\s+)?(?:reviews?|surveys?)\b",
    r"(?i)\bwe\s+(?:comprehensively\s+|systematically\s+)?survey\b",
    r"(?i)\bwe\s+(?:provide|present|give|offer)\s+(?:an?\s+|the\s+)?(?:(?:comprehensive|systematic|thorough|brief|broad|detailed|extensive|up-to-date|concise)\s+)*(?:overview|survey|review)\b",
    r"(?i)\bcomprehensive\s+(?:overview|survey|review)\b",
    r"(?i)\bwe\s+summari[sz]e\s+(?:the\s+)?recent\b",
]
DATASET_TITLE = r"(?i)\b(?:data\s*sets?|benchmarks?|database|corpus|corpora)\b"
DATASET_ABSTRACT = r"(?i)\b(?:introduce|introduces|introducing|present|presents|release|releases|collect|collected|construct|constructed|build|built|propose|proposes)(?![0-9A-Za-z_])[^.]{0,80}?(?<![0-9A-Za-z_])(?:data\s*set|dataset|benchmark|database|corpus)\b"
REFERENCE_WORK = r"(?i)\b(?:definitions?|encyclop(?:a)?edia|dictionary|glossary|wikipedia|qeios)\b"
PROCEEDINGS = r"(?i)\b(?:conference|proceedings|symposium|workshop|congress)\b"
IEEE_DOI = r"(?i)^10\.1109/[a-z][a-z0-9-]*\.((?:19|20)[0-9]{2})\.[0-9]+$"
OLD_ID = r"(?i)^[a-z-]+(?:\.[A-Z]{2})?/([0-9]{2})([0-9]{2})[0-9]{3}(?:v[0-9]+)?$"
NEW_ID = r"^([0-9]{2})([0-9]{2})\.[0-9]{4,5}(?:v[0-9]+)?$"
RESERVED_SLUGS = ("index", "search", "themes", "papers", "all")


def known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def holds(text: Column, pattern: str) -> Column:
    return F.regexp(known(text), F.lit(ascii_boundaries(pattern)))


def comment_venue(comment: Column) -> Column:
    """(venue, tier, score) that a comment announces: a known venue by tier, a workshop, or nothing (tier 0)."""
    name, workshop = F.upper(F.regexp_extract(known(comment), ACCEPTED, 1)), holds(comment, WORKSHOP)

    def found(venue: Column, tier: int, score: int) -> Column:
        return F.struct(venue.alias("venue"), F.lit(tier).alias("tier"), F.lit(score).alias("score"))

    every = [v for _, _, venues in TIERS for v in venues]
    out = F.when(name.isin(every) & workshop, found(F.concat(name, F.lit(" Workshop")), 4, 30))
    for tier, score, venues in TIERS:
        out = out.when(name.isin(*venues), found(name, tier, score))
    return out.when(workshop, found(F.lit("Workshop"), 4, 30)).otherwise(found(F.lit(None).cast("string"), 0, 0))


def decision_label(venue: Column) -> Column:
    """Oral, Spotlight or Poster, as a venue's label says; empty if it says none."""
    word = F.lower(F.regexp_extract(known(venue), DECISION, 1))
    return F.when(word == "spotlightposter", "Spotlight").otherwise(F.initcap(word))


def repository_similarity(title: Column, candidate: Column) -> Column:
    """1 if one title's letters and digits (six at least) hold the other's, else the similarity of words of three."""
    a, b = compact_key(known(title)), compact_key(known(candidate))

    def long_words(x: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(known(x)), F.lit("[a-z0-9]{3,}"), F.lit(0)))

    inside = (F.char_length(a) >= 6) & (F.char_length(b) >= 6) & (F.contains(a, b) | F.contains(b, a))
    x, y = long_words(title), long_words(candidate)
    return F.when(inside, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def is_generic_title(title: Column) -> Column:
    """One or two plain words."""
    return F.regexp(F.regexp_replace(F.trim(known(title)), r"[.:;,!?]+$", ""), F.lit(r"^[A-Za-z][a-z]+(?:\s+[A-Za-z][a-z]+)?$"))


def is_bogus(title: Column, year: Column, n_authors: Column, venue: Column) -> Column:
    """No usable paper: no title, or a generic one without a year, two authors or a venue that is no reference work."""
    doubtful = F.coalesce(year <= 0, F.lit(True)) | (F.coalesce(n_authors, F.lit(0)) < 2) | (F.trim(known(venue)) == "") | holds(venue, REFERENCE_WORK)
    return (F.trim(known(title)) == "") | (is_generic_title(title) & doubtful)


def is_survey_title(title: Column) -> Column:
    return any_of(known(title), SURVEY_TITLES)


def is_survey(title: Column, abstract: Column, venue: Column, kind: Column) -> Column:
    """A review by its publication type, title, abstract or venue."""
    return (F.lower(F.trim(known(kind))) == "review") | is_survey_title(title) | any_of(known(abstract), SURVEY_ABSTRACTS) | holds(venue, REVIEW_VENUE)


def is_dataset(title: Column, abstract: Column) -> Column:
    return holds(title, DATASET_TITLE) | holds(abstract, DATASET_ABSTRACT)


def is_denied(paper_id: Column, title: Column, ids: list[str], patterns: list[str]) -> Column:
    """In a set of ids, or of a title that matches a pattern."""
    out = paper_id.isin(ids) if ids else F.lit(False)
    for p in patterns:
        out = out | F.regexp(known(title), F.lit(p))
    return out


def preprint_year(code: Column) -> Column:
    """The year of a preprint number, of the new style (with a month) or the old one (1991 on)."""
    new, month = (F.nullif(F.regexp_extract(F.trim(known(code)), NEW_ID, k), F.lit("")).cast("int") for k in (1, 2))
    old = F.nullif(F.regexp_extract(F.trim(known(code)), OLD_ID, 1), F.lit("")).cast("int")
    return F.when(month.between(1, 12), new + 2000).when(old >= 91, old + 1900).when(old.isNotNull(), old + 2000)


def proceedings_doi_year(doi: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(known(doi)), IEEE_DOI, 1), F.lit("")).cast("int")


def earliest_year(year: Column, preprint: Column) -> Column:
    return F.least(year, preprint_year(preprint))


def corrected_year(year: Column, preprint: Column, listed_year: Column, listed_key: Column, venue: Column, doi: Column) -> Column:
    """The proceedings' year where the record is one year off: of a conference listing, else of a proceedings DOI. A
    paper that is dated by its preprint keeps its year."""
    by_listing = F.when(F.startswith(known(listed_key), F.lit("conf/")), listed_year)
    by_doi = F.when(holds(venue, PROCEEDINGS), proceedings_doi_year(doi))
    other = F.coalesce(by_listing, by_doi)
    dated = F.coalesce(preprint_year(preprint) <= year, F.lit(False))
    return F.when(~dated & (F.abs(other - year) == 1), other).otherwise(year)


def follow_score(authors: Column, affiliations: Column, names: list[str], organisations: list[str]) -> Column:
    """100 if a followed author wrote it, 50 if an affiliation holds a followed organisation, else 0."""
    wanted = F.array(*(F.lit(" ".join(n.lower().split())) for n in names)).cast("array<string>")
    by_author = F.arrays_overlap(F.transform(F.coalesce(authors, F.array()), lambda a: collapse(F.lower(a))), wanted)
    by_place = F.exists(F.coalesce(affiliations, F.array()), lambda a: F.exists(F.array(*map(F.lit, [o.lower() for o in organisations])).cast("array<string>"), lambda o: F.contains(F.lower(a), o)))
    return F.when(F.coalesce(by_author, F.lit(False)), 100).when(F.coalesce(by_place, F.lit(False)), 50).otherwise(0)


def tier_bucket(rank: Column) -> Column:
    """A+ or A is 1 or 2, a preprint 3, anything else 99; a number is itself."""
    value = F.upper(F.trim(known(rank)))
    return F.when(value == "A+", 1).when(value == "A", 2).when(value == "PREPRINT", 3).otherwise(F.coalesce(value.try_cast("int"), F.lit(99)))


def titles_disagree(a: Column, b: Column) -> Column:
    return titles_diverge(a, b, below=0.3, least=2)


def corrected_identity(title: Column, authors: Column, doi: Column, abstract: Column, other_title: Column, other_authors: Column) -> Column:
    """(title, authors, doi, abstract, changed): what a record's own identifier says wins where the record drifted.
    Without a shared surname the authors are replaced and the DOI, which is another work's, dropped; a title that
    tells of something else is replaced and the abstract blanked."""
    def surnames(x: Column) -> Column:
        return F.filter(F.transform(F.coalesce(x, F.array()), surname), lambda s: s != "")

    mine, theirs = surnames(authors), surnames(other_authors)
    strangers = (F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs)
    retitled = (known(other_title) != "") & (known(title) != known(other_title)) & (titles_disagree(title, other_title) | titles_diverge(title, other_title))
    return F.struct(
        F.when(retitled, other_title).otherwise(title).alias("title"), F.when(strangers, F.slice(other_authors, 1, 5)).otherwise(authors).alias("authors"), F.when(~strangers, doi).alias("doi"),
        F.when(retitled, "").otherwise(abstract).alias("abstract"), F.array_compact(F.array(F.when(strangers, "authors"), F.when(retitled, "title"))).alias("changed"),
    )


# Titles of events, and repositories that host slides, data and code.
EVENT_TITLE = r"(?i)\b(workshop|tutorial|lecture|lectures|keynote|slides|slide\s+deck|talk|webinar|summer\s+school|invited\s+talk)\b"
REPOSITORY_DOI = r"(?i)^10\.(5281/zenodo|6084/m9\.figshare)\."
REPOSITORY_VENUE = r"(?i)^(zenodo|figshare)\b"


def suspect_record(title: Column, venue: Column, doi: Column, cites: Column, other_cites: Column, age: Column, focus: Column) -> Column:
    """(reasons, action) of a record that may be several works merged, null if none. An event's or repository's record with 500
    citations, or any with over five times the other source's count and 300 more, is dropped unless in focus; 1,000 citations
    a year within two years are flagged only."""
    event, hosted = holds(title, EVENT_TITLE), holds(doi, REPOSITORY_DOI) | holds(venue, REPOSITORY_VENUE)
    gap = F.coalesce((cites > other_cites * 5) & (cites - other_cites > 300), F.lit(False))
    many = F.coalesce(cites >= 500, F.lit(False))
    drop = gap | ((event | hosted) & many)
    young = F.coalesce((age >= 0) & (age < 2) & (cites >= F.greatest(age, F.lit(1)) * 1000), F.lit(False)) & ~drop
    reasons = F.array_compact(F.array(
        F.when(event, "event_title"), F.when(hosted, "repository_record"), F.when(gap, "count_gap"), F.when((event | hosted) & many, "many_citations"), F.when(young, "young_and_cited"),
    ))
    return F.when(drop | young, F.struct(reasons.alias("reasons"), F.when(drop & ~F.coalesce(focus, F.lit(False)), "dropped").otherwise("flagged").alias("action")))


def sanitized(text: Column, most: int = 500) -> Column:
    """Without control, format and unassigned characters, trimmed, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(known(text), r"\p{C}", "")), 1, most)


def slug_is_valid(slug: Column, reserved: tuple[str, ...] = RESERVED_SLUGS) -> Column:
    return F.regexp(known(slug), F.lit("^[a-z0-9]+(?:-[a-z0-9]+)*$")) & ~slug.isin(*reserved)


def tidy_latex(title: Column) -> Column:
    """A title for display: math signs and braces go, commands keep what they hold, symbols are written out."""
    plain = F.regexp_replace(known(title), r"\\(?:text|math|emph)[a-z]*\{([^{}]*)\}", "$1")
    for command, sign in (("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("lambda", "λ"), ("infty", "∞"), ("times", "×"), ("to", "→")):
        plain = F.regexp_replace(plain, rf"\\{command}(?![A-Za-z])", sign)
    plain = F.regexp_replace(plain, r"\\[A-Za-z]+", "")
    return collapse(F.regexp_replace(F.regexp_replace(plain, r"[$*_{}]", ""), r"\\([&%#])", "$1"))


def title_key(title: Column) -> Column:
    """The key under which same titles meet: null for short ones (twenty characters and four words at least)."""
    plain = F.trim(F.regexp_replace(F.lower(known(title)), r"[^\p{L}\p{N}]+", " "))
    return F.when((F.char_length(plain) >= 20) & (F.size(F.split(plain, " ")) >= 4), plain)


def years_compatible(a: Column, b: Column, most: int = 1) -> Column:
    return F.coalesce(F.abs(a - b) <= most, F.lit(False))
