"""Views of one graph: year lines of a drawn lineage, and the claims that a focused view shows within its budgets.

What is relational (filters with their first reason, degrees, distances, same-year parents, heights of year bands) runs over all
graphs at once. Two steps are greedy by definition, each choice depending on those before it: packing a year's papers into lines,
and spending a view's budget of nodes and claims. They are ordered folds, one year of a graph or one graph to a group.

Defined cases: edges to papers of other years, loops and plain citations don't order a year; papers without a year come last, as
one band; on a cycle depths stop growing after as many passes as the year has papers; claims of unknown graphs
have no view; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.groups import in_groups
from lectern.plans.storage import materialize

# Sizes of a drawn card and the gaps between cards, lines and years.
CARD_WIDTH, CARD_HEIGHT, ROW_GAP, SIBLING_GAP, PADDING, LABEL_WIDTH, LINE_GAP = 260, 200, 80, 28, 56, 84, 36
# Order of relations and trust in a view.
RELATIONS = ("supersedes", "successor", "extends", "ablation", "baseline_only", "contrasts")
TRUST = ("verified", "corroborated", "tentative")
_STEP = CARD_WIDTH + SIBLING_GAP


def _packed(year: list[tuple[object, list]], per_line: int) -> tuple[list[tuple[int, int]], int]:
    """(line, column) of each of a year's papers, given from left to right with their same-year parents, and how many lines there
    are: by depth below the parents, each on the first line below its parents with room."""
    links = [(p, n) for n, own in year for p in own]
    depth = {n: 0 for n, _ in year}
    for _ in year:
        changed = False
        for p, n in links:
            if depth[n] < depth[p] + 1 < len(year):
                depth[n], changed = depth[p] + 1, True
        if not changed:
            break
    line_of: dict = {}
    used: list[int] = []
    first_free = 0  # lines before it are full
    for n, own in sorted(year, key=lambda x: depth[x[0]]):
        line = max([first_free, *(line_of[p] + 1 for p in own if p in line_of)])
        while line < len(used) and used[line] >= per_line:
            line += 1
        used += [0] * (line + 1 - len(used))
        used[line] += 1
        line_of[n] = line
        while first_free < len(used) and used[first_free] >= per_line:
            first_free += 1
    filled, out = [0] * len(used), []
    for n, _ in year:
        out.append((line_of[n], filled[line_of[n]]))
        filled[line_of[n]] += 1
    return out, len(used)


def year_lines(nodes: DataFrame, edges: DataFrame, per_line: int) -> DataFrame:
    """(graph_id, year, node, line, column, lines) of nodes(graph_id, node, year, place) and edges(graph_id, src, dst, relation):
    place is a node's rank from left to right; edges run from cited to citing."""
    own = edges.where("src <> dst and relation <> 'baseline_only'").select("graph_id", "src", "dst").distinct()
    ends = nodes.select("graph_id", "node", "year")
    same = own.join(ends.withColumnRenamed("node", "src"), ["graph_id", "src"]).join(ends.withColumnsRenamed({"node": "dst", "year": "other"}), ["graph_id", "dst"]).where(F.col("year").eqNullSafe(F.col("other")))
    parents = same.groupBy("graph_id", F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("parents"))
    rows = nodes.select("graph_id", "node", "year", "place").join(parents, ["graph_id", "node"], "left")
    kinds = dict(rows.dtypes)
    ordered = rows.repartition("graph_id", "year").sortWithinPartitions("graph_id", "year", "place").select("graph_id", "year", "node", "parents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, year, out, fields = None, [], [], None

        def done() -> None:
            placed, lines = _packed(year, per_line)
            out.extend((*key, n, line, column, lines) for (n, _), (line, column) in zip(year, placed, strict=True))
            year.clear()

        def batch_of() -> pa.RecordBatch:
            types = [*fields, pa.int32(), pa.int32(), pa.int32()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["graph_id", "year", "node", "line", "column", "lines"])

        for batch in batches:
            fields = [batch.schema.field(k).type for k in range(3)]
            for graph, when, node, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if year and (graph, when) != key:
                    done()
                key = (graph, when)
                year.append((node, own or []))
            if out:
                yield batch_of()
        if year:
            done()
            yield batch_of()

    return ordered.mapInArrow(run, f"graph_id {kinds['graph_id']}, year {kinds['year']}, node {kinds['node']}, line int, column int, lines int")


def chronological(nodes: DataFrame, edges: DataFrame, per_line: int, order: list[Column]) -> DataFrame:
    """(graph_id, node, year, x, y, width, height): every year's papers in a band below the earlier years', wrapped into lines of
    ``per_line`` at most, from left to right in the given order."""
    in_year = Window.partitionBy("graph_id", "year").orderBy(*order)
    lines = materialize(year_lines(nodes.withColumn("place", F.row_number().over(in_year)), edges, per_line), "layout-lines")
    bands = lines.groupBy("graph_id", "year").agg(F.max("lines").alias("lines"), F.count("*").alias("cards"))
    band = F.col("lines") * CARD_HEIGHT + (F.col("lines") - 1) * LINE_GAP + ROW_GAP
    above = Window.partitionBy("graph_id").orderBy(F.col("year").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("graph_id")
    bands = bands.select(
        "graph_id", F.col("year").alias("band_year"), (F.lit(PADDING) + F.coalesce(F.sum(band).over(above), F.lit(0))).alias("top"),
        (F.sum(band).over(whole) + 2 * PADDING).alias("height"), (F.lit(LABEL_WIDTH + PADDING) + F.least(F.max("cards").over(whole), F.lit(per_line)) * _STEP).alias("width"),
    )
    out = lines.join(bands, (lines["graph_id"] == bands["graph_id"]) & lines["year"].eqNullSafe(bands["band_year"])).drop(bands["graph_id"])
    return out.select("graph_id", "node", "year", (F.lit(LABEL_WIDTH + PADDING // 2) + F.col("column") * _STEP).alias("x"), (F.col("top") + F.col("line") * (CARD_HEIGHT + LINE_GAP)).alias("y"), "width", "height")


@dataclass(frozen=True)
class View:
    """What a focused view asks for; sources and kinds of evidence count only where given."""

    trust: tuple[str, ...] = ("verified", "corroborated")
    families: tuple[str, ...] = ("genealogy", "comparison")
    relations: tuple[str, ...] = RELATIONS
    sources: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None
    least_confidence: float = 0.0
    hops: int = 1
    nodes: int = 20
    claims: int = 18
    branches: int = 2  # beyond the spine, from each node
    extras: int = 6  # tentative claims, and comparisons


def first_reason(view: View) -> Column:
    """The first filter that turns a claim away; null if none does."""
    def lacks(column: str, wanted: tuple[str, ...] | None) -> Column:
        return F.lit(False) if wanted is None else ~F.arrays_overlap(F.coalesce(column, F.array().cast("array<string>")), F.array(*map(F.lit, wanted)).cast("array<string>"))

    weak = (F.col("trust") == "corroborated") & (F.col("probability").isNull() | (F.col("probability") < view.least_confidence))
    return (
        F.when(~F.coalesce(F.col("decision") == "accepted", F.lit(False)), "decision").when(~F.col("trust").isin(*view.trust), "trust").when(~F.col("family").isin(*view.families), "family")
        .when(~F.coalesce(F.col("relation").isin(*view.relations), F.lit(False)), "relation").when(weak, "confidence").when(F.coalesce(lacks("sources", view.sources) | lacks("kinds", view.kinds), F.lit(True)), "evidence")
    )


class _Budget:
    def __init__(self, focus: object, view: View) -> None:
        self.view, self.nodes, self.shown = view, {focus: None}, {}

    def add(self, claim: tuple, nodes: float | None = None, claims: float | None = None) -> bool:
        """claim: (id, src, dst, ...). Whether it is shown now; caps are the view's unless given."""
        if claim[0] in self.shown:
            return True
        new = [n for n in dict.fromkeys(claim[1:3]) if n not in self.nodes]
        if len(self.nodes) + len(new) > (self.view.nodes if nodes is None else nodes) or len(self.shown) >= (self.view.claims if claims is None else claims):
            return False
        self.nodes.update(dict.fromkeys(new))
        self.shown[claim[0]] = len(self.shown)
        return True


def _selected(rows: list[tuple], view: View) -> list[tuple]:
    """Fold of one graph's eligible claims: the spine by hops, branches of what was found, links among it, then what was asked to
    be expanded, tentative claims and comparisons."""
    graph, focus, expanded = rows[0][:3]
    claims = [r[3:] for r in rows]
    far: dict = {}
    for c in claims:
        far[c[1]], far[c[2]] = c[8], c[9]

    def order(c: tuple, at: object = None) -> tuple:
        degree = max(c[6], c[7]) if at is None else c[7] if c[1] == at else c[6]
        return (*c[5], -degree, c[1], c[2], c[0])

    firm, tentative, compared, near = [], [], [], {}
    for c in sorted(claims, key=order):
        (compared if c[3] != "genealogy" else tentative if c[4] == "tentative" else firm).append(c)
    for c in firm:
        near.setdefault(c[1], []).append(c)
        near.setdefault(c[2], []).append(c)
    for at, own in near.items():
        own.sort(key=lambda c, at=at: order(c, at))
    budget, ends, spine = _Budget(focus, view), {1: focus, 2: focus}, [focus]
    for _ in range(view.hops):
        for side, away in ((2, 1), (1, 2)):  # first to what it builds on, then to what builds on it
            at = ends[away]
            chosen = next((c for c in near.get(at, ()) if c[side] == at and c[0] not in budget.shown), None)
            if chosen and budget.add(chosen):
                ends[away] = chosen[away]
                spine.append(chosen[away])
    queue = list(dict.fromkeys(spine))
    for at in queue:
        grown = 0
        for c in near.get(at, ()):
            other = c[2] if c[1] == at else c[1]
            if c[0] in budget.shown or far[other] > view.hops or other in budget.nodes:
                continue
            if grown >= view.branches:
                break
            if budget.add(c):
                queue.append(other)
                grown += 1
    for c in firm:
        if len(budget.shown) >= view.claims:
            break
        if c[1] in budget.nodes and c[2] in budget.nodes:
            budget.add(c)
    for at in [n for n in (expanded if expanded is not None else ()) if n in budget.nodes]:
        grown = 0
        for c in near.get(at, ()):
            other = c[2] if c[1] == at else c[1]
            if c[0] in budget.shown or other in budget.nodes:
                continue
            if grown >= view.branches:
                break
            grown += budget.add(c, float("inf"), float("inf"))
    for group, anywhere in ((tentative, True), (compared, False)):
        added = 0
        for c in group:
            if added >= view.extras or len(budget.shown) >= view.claims:
                break
            both = c[1] in budget.nodes and c[2] in budget.nodes
            touches = (c[1] in budget.nodes or c[2] in budget.nodes) if anywhere else both or focus in c[1:3]
            if touches and budget.add(c, float("inf") if both and not anywhere else None):
                added += 1

    def reason(c: tuple) -> str | None:
        if c[0] in budget.shown:
            return None
        if c[3] == "genealogy" and max(c[8], c[9]) > view.hops:
            return "hop"
        if len(budget.nodes) >= view.nodes and not (c[1] in budget.nodes and c[2] in budget.nodes):
            return "node_cap"
        return "claim_cap" if len(budget.shown) >= view.claims else "branch"

    return [(graph, c[0], budget.shown.get(c[0]), reason(c)) for c in claims]


def focus_projection(claims: DataFrame, focus: DataFrame, view: View) -> DataFrame:
    """(graph_id, id, shown, reason): shown is a claim's place in the view (from 0), else reason tells what kept it out. claims has graph_id,
    id, src, dst, decision, trust, family, relation, probability, sources and kinds; focus has graph_id, node and expanded, a
    graph each."""
    c = F.col
    marked = materialize(claims.join(focus.select("graph_id", c("node").alias("focus"), "expanded"), "graph_id").withColumn("reason", first_reason(view)), "view-claims")
    ends = F.explode(F.array("src", "dst")).alias("node")
    degrees = marked.where("decision = 'accepted' and family = 'genealogy'").select("graph_id", ends).groupBy("graph_id", "node").agg(F.count("*").alias("degree"))
    eligible = marked.where("reason is null").drop("reason")
    firm = eligible.where("family = 'genealogy' and trust <> 'tentative'")
    ways = materialize(firm.select("graph_id", F.explode(F.array(F.struct(c("src").alias("node"), c("dst").alias("next")), F.struct(c("dst").alias("node"), c("src").alias("next")))).alias("x")).select("graph_id", "x.*").distinct(), "view-ways")
    reached = focus.select("graph_id", "node", F.lit(0).alias("far"))
    for hop in range(1, view.hops + 1):
        further = reached.where(c("far") == hop - 1).join(ways, ["graph_id", "node"]).select("graph_id", c("next").alias("node"), F.lit(hop).alias("far"))
        reached = reached.unionByName(further).groupBy("graph_id", "node").agg(F.min("far").alias("far"))
    around = materialize(degrees.join(reached, ["graph_id", "node"], "full_outer"), "view-around")
    for end in ("src", "dst"):
        own = around.select("graph_id", c("node").alias(end), F.coalesce("degree", F.lit(0)).alias(f"{end}_degree"), F.coalesce("far", F.lit(1 << 30)).alias(f"{end}_far"))
        eligible = eligible.join(own, ["graph_id", end], "left").fillna({f"{end}_degree": 0, f"{end}_far": 1 << 30})
    trust = F.array_position(F.array(*map(F.lit, TRUST)), c("trust"))
    relation = F.array_position(F.array(*map(F.lit, RELATIONS)), c("relation"))
    ranked = eligible.withColumn("rank", F.array(trust.cast("double"), -F.coalesce("probability", F.lit(-1.0)), relation.cast("double")))
    kinds = dict(claims.dtypes)

    columns = ["graph_id", "focus", "expanded", "id", "src", "dst", "family", "trust", "rank", "src_degree", "dst_degree", "src_far", "dst_far"]
    like = claims.sparkSession.createDataFrame([], f"graph_id {kinds['graph_id']}, id {kinds['id']}, shown int, reason string")
    chosen = in_groups(ranked.select(*columns), lambda rows: _selected(rows, view), like)
    return chosen.unionByName(marked.where("reason is not null").select("graph_id", "id", F.lit(None).cast("int").alias("shown"), "reason"))
