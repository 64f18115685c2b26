"""Guards of a theme's graph: weak entries that nothing corroborates go, round by round, until none goes; and the topic gate run
again over a built graph.

Everything is keyed by (graph_id, node), so graphs of any number and size run side by side. Each round is cut by writing to the
shared folder and only touches graphs in which something went in the round before; a run that has not settled after ``most``
rounds is an error, never a partial answer.

Defined cases: edges to unknown nodes and loops count for nothing; parallel edges are one link, and one of them that states a
claim is enough; nodes without links stay (another step prunes them); empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.storage import discard, materialize

_KEY = ["graph_id", "node"]
#: Relations that state a lineage claim, and methods whose edges carry no quoted cue.
CLAIMS = ("extends", "successor", "supersedes", "contrasts")
CUELESS = ("api_citation", "citation_heuristic", "year_cite", "foundational_allowlist")


def entry_kinds(nodes: DataFrame, z_high: float) -> DataFrame:
    """(graph_id, node, kind, z) of nodes with seed, support, admitted, z and about (whether title or abstract is about the theme):
    seed and support are never checked and never lend; weak_subject and weak_mention have an embedding score below ``z_high``;
    lender is admitted otherwise, or not recorded but about the theme; the rest is inert."""
    c = F.col
    weak = c("admitted") & c("z").isNotNull() & (c("z") < z_high)
    kind = F.when(c("seed"), "seed").when(c("admitted") & c("support"), "support").when(weak & c("about"), "weak_subject").when(weak, "weak_mention").when(c("admitted") | c("about"), "lender").otherwise("inert")
    return nodes.select("graph_id", "node", kind.alias("kind"), "z")


def _links(edges: DataFrame) -> DataFrame:
    """(graph_id, node, other, cue): both directions of each link, and whether an edge of it states a claim with a cue."""
    cue = F.col("relation").isin(*CLAIMS) & ~F.coalesce(F.col("method"), F.lit("")).isin(*CUELESS)
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    both = edges.where("src <> dst").select("graph_id", F.explode(ends).alias("x"), cue.alias("cue"))
    return both.groupBy("graph_id", "x.node", "x.other").agg(F.bool_or("cue").alias("cue"))


def _unsupported(live: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(graph_id, node, kind, z): weak nodes with links that neither pass by themselves nor are reached from a lender through weak ones."""
    other = live.select("graph_id", F.col("node").alias("other"), F.col("kind").alias("other_kind"))
    around = materialize(links.join(live, _KEY).join(other, ["graph_id", "other"]), "guard-around")
    counts = around.groupBy(*_KEY).agg(F.first("kind").alias("kind"), F.first("z").alias("z"), F.bool_or("cue").alias("cue"), F.count_if(F.col("other_kind") != "weak_mention").alias("firm"))
    weak = F.col("kind").isin("weak_subject", "weak_mention")
    passes = F.col("cue") | ((F.col("kind") == "weak_subject") & (F.col("firm") >= 2))
    judged = materialize(counts.where(weak).withColumn("passes", passes), "guard-judged")
    spread = around.where(weak).select("graph_id", F.col("other").alias("node"), F.col("node").alias("next"))
    lenders = judged.where("passes").select(*_KEY).unionByName(live.where("kind = 'lender'").select(*_KEY))
    reached = frontier = materialize(lenders, "guard-lenders")
    waiting = judged.where("not passes").select(*_KEY)
    for _ in range(most):
        step = frontier.join(spread, _KEY).select("graph_id", F.col("next").alias("node")).distinct()
        frontier = materialize(step.join(waiting, _KEY, "left_semi").join(reached, _KEY, "left_anti"), "guard-step")
        if frontier.isEmpty():
            gone = materialize(judged.where("not passes").join(reached, _KEY, "left_anti").select(*_KEY, "kind", "z"), "guard-gone")
            discard(around)
            discard(judged)
            return gone
        reached = reached.unionByName(frontier)
    raise RuntimeError(f"still spreading after {most} steps")


def confirm_weak(kinds: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(graph_id, node, rule, z, round) of the weak entries that go: single_link for those about the theme, uncorroborated for those
    that only mention it. A node that goes takes its links with it, which may take others in the next round."""
    live, links = materialize(kinds, "guard-live"), materialize(_links(edges), "guard-links")
    dropped = None
    for turn in range(1, most + 1):
        gone = _unsupported(live, links, most)
        if gone.isEmpty():
            found = gone if dropped is None else dropped
            rule = F.when(F.col("kind") == "weak_subject", "single_link").otherwise("uncorroborated")
            return found.select("graph_id", "node", rule.alias("rule"), "z", (F.col("round") if dropped is not None else F.lit(1)).alias("round"))
        numbered = gone.withColumn("round", F.lit(turn))
        dropped = numbered if dropped is None else dropped.unionByName(numbered)
        touched = gone.select("graph_id").distinct()
        live = materialize(live.join(touched, "graph_id", "left_semi").join(gone, _KEY, "left_anti"), "guard-live")
    raise RuntimeError(f"still dropping after {most} rounds")


def readmit(nodes: DataFrame, edges: DataFrame, least_support: int) -> DataFrame:
    """(graph_id, node, kept, reason, support) of nodes with focus, role (subject, component, abstract or none), on_topic, foundational
    and dataset. A descendant (it cites a focus node and none cites it) needs a title about the theme, or a mention and support; any
    other node a mention, or support unless it is a dataset. Only nodes on topic outside the focus lend support. Then
    nodes outside the focus without a link to a kept one go. A link is mutual, so taking them away unlinks no kept node: one
    round is the fixpoint."""
    c = F.col
    ends = F.array(F.struct(c("src").alias("node"), c("dst").alias("other"), F.lit(False).alias("cites")), F.struct(c("dst").alias("node"), c("src").alias("other"), F.lit(True).alias("cites")))
    ways = edges.select("graph_id", F.explode(ends).alias("x")).select("graph_id", "x.*").distinct()
    one = nodes.dropDuplicates(_KEY)
    entry = ways.join(one.where("focus").select("graph_id", c("node").alias("other")), ["graph_id", "other"]).groupBy(*_KEY).agg(F.bool_or("cites").alias("cites_focus"), F.bool_or(~c("cites")).alias("cited_by_focus"))
    descends = F.coalesce(c("cites_focus") & ~c("cited_by_focus"), F.lit(False)) & ~c("focus")
    first = F.when(c("focus"), F.concat(F.lit("focus("), c("role"), F.lit(")"))).when(descends, F.when(c("role") == "subject", "topic(descendant)")).when(c("on_topic"), "topic")
    judged = materialize(one.join(entry, _KEY, "left").withColumn("descends", descends).withColumn("first", first), "gate-judged")
    lends = judged.where(~c("focus") & c("first").isin("topic", "topic(descendant)")).select("graph_id", c("node").alias("other"))
    neighbours = ways.select("graph_id", "node", "other").distinct()
    supported = neighbours.join(lends, ["graph_id", "other"]).groupBy(*_KEY).agg(F.count("*").alias("support"))
    enough = (c("support") >= least_support) & F.lit(least_support > 0)
    second = (
        F.when(c("first").isNotNull(), c("first"))
        .when(c("descends"), F.when((c("role") != "none") & enough, "support(descendant)"))
        .when(enough & ~c("dataset"), "support")
    )
    rule = F.when(c("descends"), F.concat(F.lit("descendant("), c("role"), F.lit(")"))).when(c("dataset"), "support(dataset)").otherwise("support")
    gated = judged.join(supported, _KEY, "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long"))).withColumn("admitted", second).withColumn("rule", rule)
    gated = materialize(gated.select(*_KEY, "focus", "support", "admitted", "rule"), "gate-gated")
    kept = gated.where("admitted is not null").select("graph_id", c("node").alias("other"))
    linked = neighbours.where("node <> other").join(kept, ["graph_id", "other"]).select(*_KEY).distinct().withColumn("linked", F.lit(True))
    stands = c("admitted").isNotNull() & (c("focus") | F.coalesce(c("linked"), F.lit(False)))
    reason = F.when(stands, c("admitted")).when(c("admitted").isNotNull(), "edgeless").otherwise(c("rule"))
    return gated.join(linked, _KEY, "left").select("graph_id", "node", stands.alias("kept"), reason.alias("reason"), "support")


def topical_root(nodes: DataFrame, edges: DataFrame, rank: Column) -> DataFrame:
    """(graph_id, node): of each graph's focus nodes that of the highest rank, then of most edges to nodes on topic, then of most
    edges, then the first."""
    c = F.col
    ends = F.array(F.struct(c("src").alias("node"), c("dst").alias("other")), F.struct(c("dst").alias("node"), c("src").alias("other")))
    both = edges.select("graph_id", F.explode(ends).alias("x")).select("graph_id", "x.*")
    topics = nodes.select("graph_id", c("node").alias("other"), "on_topic")
    degrees = both.join(topics, ["graph_id", "other"], "left").groupBy(*_KEY).agg(F.count_if("on_topic").alias("topical"), F.count("*").alias("degree"))
    ranked = nodes.where("focus").withColumn("rank", rank).join(degrees, _KEY, "left").fillna(0, ["topical", "degree"])
    best = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("rank"), F.desc("topical"), F.desc("degree"), "node"))
    return ranked.withColumn("_r", best).where("_r = 1").select("graph_id", "node")
