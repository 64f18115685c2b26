"""Graph operators. Whole-corpus ones are relational rounds with the plan cut each round; steps that are sequential
by nature (longest paths with ties, shortest chains) run per small graph, keyed by graph_id."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.operators.groups import in_groups
from lectern.plans.storage import materialize

STRONG = frozenset(("supersedes", "successor", "extends"))


def hops(edges: DataFrame, most: int) -> DataFrame:
    """(root, node, hop, chain) for all nodes within ``most`` edges of each root: by the fewest, and of those by the chain
    whose nodes come first."""
    step = found = edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct().select("root", "node", F.lit(1).cast("long").alias("hop"), F.array("root", "node").alias("chain"))
    for k in range(2, most + 1):
        further = step.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.concat("chain", F.array("dst")).alias("chain"))
        step = further.groupBy("root", "node").agg(F.lit(k).cast("long").alias("hop"), F.min("chain").alias("chain"))
        found = found.unionByName(step)
    return found.groupBy("root", "node").agg(F.min(F.struct("hop", "chain")).alias("best")).select("root", "node", "best.hop", "best.chain")


def reachable(seeds: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """Nodes that a chain of edges from a seed reaches, seeds included."""
    edges, found = materialize(edges, "reach-edges"), materialize(seeds.distinct(), "reach")
    frontier = found
    for _ in range(most):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(found, "node", "left_anti"), "reach-frontier")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise RuntimeError(f"still growing after {most} steps")


def bounded_bfs(seeds: DataFrame, edges: DataFrame, depth: int, width: int, order: list[Column]) -> DataFrame:
    """(graph_id, node, depth): at each level the first ``width`` neighbours of each node, by the fewest steps."""
    found = seeds.select("graph_id", "node", F.lit(0).cast("long").alias("depth"))
    frontier = found
    for k in range(1, depth + 1):
        near = frontier.select("graph_id", F.col("node").alias("src")).join(edges, ["graph_id", "src"])
        rank = F.row_number().over(Window.partitionBy("graph_id", "src").orderBy(*order))
        frontier = materialize(near.withColumn("_r", rank).where(F.col("_r") <= width).select("graph_id", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(k).cast("long")), "bfs")
        found = found.unionByName(frontier)
    return found.groupBy("graph_id", "node").agg(F.min("depth").alias("depth"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, most: int = 20_000) -> DataFrame:
    """(graph_id, node, rank): rank flows from a citing to a cited node, dangling mass is shared within the graph. Edges have
    graph_id. Graphs of at most ``most`` nodes and edges stream through a task, all rounds at once; larger ones are ranked in
    rounds of joins, each of which shuffles every node and edge."""
    parts = nodes.select("graph_id", F.col("node").alias("a"), F.lit(None).cast(edges.schema["src"].dataType).alias("b"), F.lit(False).alias("edge"))
    parts = parts.unionByName(edges.select("graph_id", F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("edge")))
    large = materialize(parts.groupBy("graph_id").count().where(F.col("count") > most).select("graph_id"), "rank-large")

    def ranked(group: list[tuple]) -> list[tuple]:
        at = {row[1]: k for k, row in enumerate(r for r in group if not r[3])}
        n, degree = len(at), [0] * len(at)
        links = [(at[f], at.get(t)) for _, f, t, edge in group if edge and f in at]
        for f, _ in links:
            degree[f] += 1
        inner = [(f, t) for f, t in links if t is not None]
        now = [1.0 / n] * n if n else []
        for _ in range(rounds):
            share = [r / k if k else 0.0 for r, k in zip(now, degree, strict=True)]
            loose = sum(r for r, k in zip(now, degree, strict=True) if not k) / n if n else 0.0
            flow = [0.0] * n
            for f, t in inner:
                flow[t] += share[f]
            now = [(1 - damping) / n + damping * (x + loose) for x in flow]
        return [(group[0][0], node, r) for node, r in zip(at, now, strict=True)]

    like = _empty(nodes, StructType([nodes.schema["graph_id"], nodes.schema["node"], StructField("rank", DoubleType())]))
    if large.isEmpty():
        return in_groups(parts, ranked, like)
    small = in_groups(parts.join(large, "graph_id", "left_anti"), ranked, like)
    return small.unionByName(_rank_rounds(nodes.join(large, "graph_id", "left_semi"), edges.join(large, "graph_id", "left_semi"), rounds, damping))


def _rank_rounds(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    """The same by joins over all graphs at once."""
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"))
    sized = nodes.withColumn("n", F.count("*").over(Window.partitionBy("graph_id"))).join(degree, "node", "left")
    fixed = materialize(sized.select("graph_id", "node", "n", "k"), "rank-nodes")
    links = materialize(edges.select(F.col("dst").alias("f"), F.col("src").alias("t")), "rank-edges")
    now = fixed.withColumn("rank", F.lit(1.0) / F.col("n"))
    for turn in range(1, rounds + 1):
        flow = now.where("k is not null").join(links, F.col("node") == F.col("f")).groupBy(F.col("t").alias("node")).agg(F.sum(F.col("rank") / F.col("k")).alias("flow"))
        loose = now.where("k is null").groupBy("graph_id").agg(F.sum("rank").alias("loose"))
        parts = fixed.join(flow, "node", "left").join(loose, "graph_id", "left")
        shared = F.coalesce("flow", F.lit(0.0)) + F.coalesce("loose", F.lit(0.0)) / F.col("n")
        now = parts.select("graph_id", "node", "n", "k", (F.lit(1 - damping) / F.col("n") + F.lit(damping) * shared).alias("rank"))
        if turn % 5 == 0:
            now = materialize(now, "rank")
    return now.select("graph_id", "node", "rank")


def longest_depth(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, depth): edges on the longest chain that ends in the node; acyclic edges. A chain longer
    than ``most`` or a cycle is an error."""
    edges = materialize(edges, "depth-edges")
    found = nodes.select("node", F.lit(0).cast("long").alias("depth"))
    frontier = found.select("node")
    for k in range(1, most + 1):
        frontier = materialize(frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct(), "depth")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(k).cast("long")))
    else:
        raise RuntimeError(f"a chain has more than {most} edges, or edges run in a cycle")
    return found.groupBy("node").agg(F.max("depth").alias("depth"))


def _empty(like: DataFrame, schema: str | StructType) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def _topological(rows: list[tuple]) -> list[tuple[int, int]]:
    """(year, node) of rows (graph_id, src, dst, src_year, dst_year, …) in an order where cited nodes come first; ties and cycles
    by year (none last), then id."""
    known = {r[1]: r[3] for r in rows} | {r[2]: r[4] for r in rows}
    year = {n: 1 << 30 if y is None else y for n, y in known.items()}
    waiting, out = dict.fromkeys(year, 0), defaultdict(list)
    for s, d in dict.fromkeys((r[1], r[2]) for r in rows):
        out[s].append(d)
        waiting[d] += 1
    ready, order, left = [(year[n], n) for n, k in waiting.items() if not k], [], set(year)
    heapq.heapify(ready)
    while left:
        if not ready:
            heapq.heappush(ready, min((year[n], n) for n in left))
        at = heapq.heappop(ready)
        if at[1] not in left:
            continue
        left.discard(at[1])
        order.append(at)
        for d in out[at[1]]:
            waiting[d] -= 1
            if not waiting[d] and d in left:
                heapq.heappush(ready, (year[d], d))
    return order


# How much a relation counts on the main path.
MAIN_PATH_WEIGHTS = {"supersedes": 3.0, "extends": 3.0, "successor": 2.5, "ablation": 2.0, "contrasts": 1.5, "baseline_only": 1.0}


def oriented(edges: DataFrame) -> DataFrame:
    """Edges from the older to the newer end: a citation against the years is turned round, loops go."""
    against = F.coalesce(F.col("src_year"), F.lit(1 << 30)) > F.coalesce(F.col("dst_year"), F.lit(1 << 30))
    turned = {"src": F.when(against, F.col("dst")).otherwise(F.col("src")), "dst": F.when(against, F.col("src")).otherwise(F.col("dst"))}
    years = {"src_year": F.when(against, F.col("dst_year")).otherwise(F.col("src_year")), "dst_year": F.when(against, F.col("src_year")).otherwise(F.col("dst_year"))}
    return edges.where("src <> dst").withColumns({**turned, **years})


def _main_path(rows: list[tuple]) -> list:
    """Nodes of one graph's main path. rows: oriented edges, parallel ones kept, each a claim of its own."""
    place = {n: k for k, (_, n) in enumerate(_topological(rows))}
    links = []
    for _, s, d, _, _, relation, confidence in rows:
        first, last = (s, d) if place[s] < place[d] else (d, s)  # a cycle within a year is cut by the order
        sure = min(1.0, max(0.05, confidence)) if confidence is not None and confidence == confidence else 0.5
        links.append((first, last, MAIN_PATH_WEIGHTS.get(relation, 1.0) * sure, (place[first], s, d, relation)))
    into, out = defaultdict(list), defaultdict(list)
    for link in links:
        out[link[0]].append(link)
        into[link[1]].append(link)
    order = sorted(place, key=place.get)
    before, after = {}, {}
    for n in order:
        before[n] = sum(before[x[0]] for x in into[n]) if into[n] else 1
    for n in reversed(order):
        after[n] = sum(after[x[1]] for x in out[n]) if out[n] else 1
    top = max(before[x[0]] * after[x[1]] for x in links)
    score, via = {}, {}
    for n in order:
        score[n], via[n] = 0.0, None
        for x in into[n]:
            total = score[x[0]] + before[x[0]] * after[x[1]] / top * x[2]
            if via[n] is None or total > score[n] + 1e-12 or (abs(total - score[n]) <= 1e-12 and x[3] < via[n][3]):
                score[n], via[n] = total, x
    at = None
    for n in order:
        if not out[n] and (at is None or score[n] > score[at] + 1e-12):
            at = n
    path = [at]
    while via[at]:
        at = via[at][0]
        path.append(at)
    return path[::-1]


def main_paths(edges: DataFrame) -> DataFrame:
    """(graph_id, pos, node): the chain of the largest sum of path counts, weighted by relation and confidence.

    An edge counts by the source-to-sink paths that use it, relative to the most used one. Ties take the edge of the
    older, then smaller nodes. Edges without a ``confidence`` column count half.
    """
    known = edges if "confidence" in edges.columns else edges.withColumn("confidence", F.lit(0.5))
    links = oriented(known.select("graph_id", "src", "dst", "src_year", "dst_year", "relation", F.col("confidence").cast("double").alias("confidence")))

    def work(rows: list[tuple]) -> list[tuple]:
        return [(rows[0][0], k, node) for k, node in enumerate(_main_path(rows))]

    return in_groups(links, work, _empty(edges, "graph_id long, pos long, node long"))


def shortest_paths(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(graph_id, cost, hops) from each graph's first to its last node: a strong edge costs 1, another 2."""

    def work(rows: list[tuple]) -> list[tuple]:
        out = defaultdict(list)
        for _, s, d, r, _, _ in rows:
            out[s].append((1 if r in STRONG else 2, d))
        graph_id, first, last = rows[0][0], *rows[0][4:]
        queue, done = [(0, 0, first)], set()
        while queue:
            cost, hop, at = heapq.heappop(queue)
            if at == last:
                return [(graph_id, cost, hop)]
            if at not in done:
                done.add(at)
                for more, d in out[at]:
                    heapq.heappush(queue, (cost + more, hop + 1, d))
        return []

    links = edges.join(ends.select("graph_id", "first", "last").dropDuplicates(["graph_id"]), "graph_id")
    return in_groups(links.select("graph_id", "src", "dst", "relation", "first", "last"), work, _empty(edges, "graph_id long, cost long, hops long"))


def families(edges: DataFrame, least: int = 2) -> DataFrame:
    """(graph_id, node, first, second): the node without which the graph falls into the best second component.

    One walk in depth first order tells for every node what falls off without it: a subtree from which no edge leads
    above the node is a component of its own. Time is linear in a graph's edges.
    """

    def work(rows: list[tuple]) -> list[tuple]:
        near = defaultdict(set)
        for _, s, d in rows:
            near[s].add(d)
            near[d].add(s)
        seen, low, size, cut, tops = {}, {}, {}, defaultdict(list), []
        for top in sorted(near):
            if top in seen:
                continue
            first = len(seen)
            stack = [(top, None, iter(near[top] - {top}))]
            seen[top] = low[top] = len(seen)
            size[top] = 1
            while stack:
                at, above, others = stack[-1]
                for n in others:
                    if n not in seen:
                        seen[n] = low[n] = len(seen)
                        size[n] = 1
                        stack.append((n, at, iter(near[n] - {n})))
                        break
                    if n != above:
                        low[at] = min(low[at], seen[n])
                else:
                    stack.pop()
                    if above is not None:
                        size[above] += size[at]
                        low[above] = min(low[above], low[at])
                        if low[at] >= seen[above]:
                            cut[above].append(size[at])
            tops.append((len(seen) - first, top, first))
        sizes, firsts = sorted((t[0] for t in tops), reverse=True), [t[2] for t in tops]
        best = None
        for gone in sorted(near):
            whole = tops[bisect_right(firsts, seen[gone]) - 1][0]
            rest = whole - 1 - sum(cut[gone])
            others = list(sizes[:3])
            if whole in others:
                others.remove(whole)
            parts = sorted([*cut[gone], *([rest] if rest else []), *others], reverse=True)
            if len(parts) > 1 and parts[1] >= least and (best is None or parts[1] > best[2]):
                best = (gone, parts[0], parts[1])
        return [(rows[0][0], *best)] if best else []

    return in_groups(edges.select("graph_id", "src", "dst"), work, _empty(edges, "graph_id long, node long, first long, second long"))


def genealogy_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, mean, x): within its year's line a node stands by the mean place of its parents, those without any last, then
    by citations and id. nodes(graph_id, node, yr, cites), edges(src, dst); lines are laid from the oldest year on.
    """
    every, links = materialize(nodes, "genealogy-nodes"), materialize(edges.select("src", "dst").distinct(), "genealogy-edges")
    place = Window.partitionBy("graph_id").orderBy(F.asc_nulls_last("mean"), F.desc("cites"), "node")
    laid = None
    for row in every.select("yr").distinct().orderBy("yr").collect():  # one round a year
        line = every.where(F.col("yr") == row["yr"])
        if laid is None:
            told = line.withColumn("mean", F.lit(None).cast("double"))
        else:
            mean = links.join(laid.select(F.col("node").alias("src"), "x"), "src").groupBy(F.col("dst").alias("node")).agg(F.avg("x").alias("mean"))
            told = line.join(mean, "node", "left")
        now = materialize(told.select("node", "mean", (F.row_number().over(place) - 1).cast("long").alias("x")), "genealogy")
        laid = now if laid is None else laid.unionByName(now)
    return laid
