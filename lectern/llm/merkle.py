"""Merkle manifest of a dataset: a tree of SHA-256 digests per source, a tree over the sources' roots, and proofs by a
recursive query that climbs from every leaf to the root.

``H`` is SHA-256 over the concatenated lower-case hex texts of digests. Each source's leaves ascend by id; while more than
one node remains, every three consecutive ones (the last run: fewer) become their H. What remains is the source's
subroot; the subroots, ordered by source, make a tree of the same kind.

Building. Leaves are dealt by ranges of (source, id) and numbered by offsets, so a source of any share spreads over many
tasks. Then ``3 ** LEVELS`` = 81 consecutive nodes at a time become one row that holds their levels as strings of digests,
and the rows' tops are the nodes of the next step: a tree over a trillion leaves takes seven steps, each a shuffle of an
81st of the one before. Nothing larger than 81 digests is ever in one row.

Climbing. The nodes above the packs are stored as rows, each with the run of siblings that it stands in and a link to its
parent. A recursive query starts with one row per pack, which holds the digests that its leaves have been folded to, since
the leaves of a pack have the same ancestors from its top on. Each round joins the rows with the node that they stand
at, appends that node's siblings to the proof, folds every leaf's digest with them and goes on at the parent, until no node
is left, at the root. Near the root many rows meet the same node: there the nodes are few, so Spark broadcasts them or,
by adaptive skew joins, splits the rows. The query's rows are written to the shared folder.

Defined cases: a null in any column is digested as ``-``; rows with a null id come first in their source and are never
tampered with; rows that share source and id are ordered by their digests, so equal rows are interchangeable and each is a
leaf; the null source is a source, ordered first; a lone leaf is its own subroot, a lone subroot the root, with an empty
proof; texts are digested whole; further columns are not part of a leaf; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.ordinals import sorted_ordinal
from lectern.plans.storage import discard, materialize

LEVELS = 4
_WIDTH = 3**LEVELS
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, has, source, leaf, bent): the digest of each row, and that of the row whose text has lost its line feeds where
    2 divides the CRC-32 of its decimal id (null where it is the same). ``has`` is false for the null source, whose name is
    empty here, so that it sorts first and joins."""
    bent = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.when(F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit(""))))
    head = [_part(F.col(c)) for c in FIELDS[:-1]]
    return docs.select(*FIELDS).select(
        "doc_id", F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("source"),
        F.unhex(F.sha2(F.concat(*head, _part(F.col("text"))), 256)).alias("leaf"),
        F.when(bent.isNotNull(), F.unhex(F.sha2(F.concat(*head, _part(bent)), 256))).alias("bent"),
    )


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with tree, pos and n, and the sources with tree and n. tree is the source's place among the sources, pos the
    leaf's in the source, n the number of the source's leaves."""
    order = ["has", "source", "doc_id", "leaf"]
    local = (1 << 33) - 1  # the part of Spark's increasing ids that counts within a partition
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "merkle-dealt")
    dealt = dealt.withColumn("part", F.shiftright("m", 33)).withColumn("i", F.col("m").bitwiseAND(F.lit(local)))
    cells = materialize(dealt.groupBy("part", "has", "source").agg(F.count("*").alias("here"), F.min("i").alias("first")), "merkle-cells")
    sources = materialize(sorted_ordinal(cells.groupBy("has", "source").agg(F.sum("here").alias("n")), ["has", "source"]).withColumnRenamed("ordinal", "tree"), "merkle-sources")
    earlier = Window.partitionBy("has", "source").orderBy("part")
    starts = cells.withColumn("start", F.sum("here").over(earlier) - F.col("here") - F.col("first")).join(sources, ["has", "source"])
    placed = dealt.join(starts.drop("here", "first"), ["part", "has", "source"])
    return placed.select("doc_id", "leaf", "bent", "tree", (F.col("i") + F.col("start")).alias("pos"), "n"), sources


def _height(n: Column) -> Column:
    """Levels above n leaves: the least k with 3 ** k >= n."""
    steps = F.expr("sequence(0, 39)")
    return F.size(F.filter(steps, lambda k: F.pow(F.lit(3.0), k) < n))


_H = "unhex(sha2(lower(hex({})), 256))"
_RUN = "substring({level}, 96 * ({slot} div 3) + 1, 96)"
_OTHERS = "concat(substring({run}, 1, 32 * {k}), substring({run}, 32 * {k} + 33))"
_PLACED = "concat(substring({run}, 1, 32 * {k}), {digest}, substring({run}, 32 * {k} + 33))"


def _above(level: str) -> Column:
    """The level above one, both as strings of digests."""
    return F.expr(f"aggregate(sequence(0, (length({level}) - 1) div 96), X'', (a, i) -> concat(a, {_H.format(f'substring({level}, 96 * i + 1, 96)')}))")


def _packed(nodes: DataFrame, *kept: str) -> DataFrame:
    """(tree, pack, height, items, levels, top) of 81 consecutive nodes each: nodes has tree, pos, height (levels from there to
    the tree's top) and digest. levels holds up to ``LEVELS`` + 1 strings of digests, from the nodes themselves to their top."""
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", *kept)))
    packs = nodes.withColumn("pack", F.expr(f"pos div {_WIDTH}")).groupBy("tree", "pack").agg(F.first("height").alias("height"), items.alias("items"))
    packs = packs.withColumn("l0", F.expr("aggregate(items, X'', (a, x) -> concat(a, x.digest))"))
    for k in range(LEVELS):
        packs = packs.withColumn(f"l{k + 1}", _above(f"l{k}"))
    levels = packs.withColumn("levels", F.array(*(f"l{k}" for k in range(LEVELS + 1)))).drop(*(f"l{k}" for k in range(LEVELS + 1)))
    return levels.withColumn("top", F.expr(f"element_at(levels, least({LEVELS}, height) + 1)"))


def _rows(packs: DataFrame, base: int) -> DataFrame:
    """A row for each node in packs that has a parent in its tree: tree, level, pos, the run that it stands in and its slot there."""
    at = F.expr(
        f"""flatten(transform(sequence(0, {LEVELS - 1}), k -> if(k >= height, array(), transform(sequence(0, length(levels[k]) div 32 - 1), i -> named_struct(
          'level', {base} + k, 'pos', pack * element_at(array(81L, 27L, 9L, 3L), k + 1) + i, 'slot', CAST(i % 3 AS INT), 'run', {_RUN.format(level="levels[k]", slot="i")})))))"""
    )
    return packs.select("tree", F.explode(at).alias("x")).select("tree", "x.*")


class Manifest:
    """A built manifest: packs of leaves, node rows above them, sources, and the root (None for an empty dataset)."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark: SparkSession = docs.sparkSession
        first = materialize(leaves(docs), "merkle-leaves")
        numbered, self.sources = _numbered(first)
        nodes = numbered.withColumn("height", _height(F.col("n"))).withColumnRenamed("leaf", "digest")
        self.packs = materialize(_packed(nodes, "doc_id", "bent"), "merkle-packs")
        discard(first)
        found, tops, frame, level = [], [], self.packs, 0
        while True:
            tops.append(frame.where(f"height <= {LEVELS}").select(F.col("tree").alias("pos"), F.col("top").alias("digest")))
            level += LEVELS
            above = frame.where(f"height > {LEVELS}").select("tree", F.col("pack").alias("pos"), (F.col("height") - LEVELS).alias("height"), F.col("top").alias("digest"))
            if above.isEmpty():
                break
            frame = materialize(_packed(above), "merkle-level")
            found.append(_rows(frame, level))
        self.subroots = tops[0]
        for more in tops[1:]:
            self.subroots = self.subroots.unionByName(more)
        self.subroots = materialize(self.subroots, "merkle-subroots")
        count = self.subroots.count()
        self.height = self.spark.range(1).select(_height(F.lit(count))).first()[0]
        frame, level, left, self.root = self.subroots.select(F.lit(-1).cast("long").alias("tree"), "pos", F.lit(self.height).alias("height"), "digest"), 0, self.height, None
        while count:
            frame = materialize(_packed(frame), "merkle-level")
            found.append(_rows(frame, level))
            if left <= LEVELS:
                self.root = bytes(frame.first()["top"])
                break
            level, left = level + LEVELS, left - LEVELS
            frame = frame.select("tree", F.col("pack").alias("pos"), (F.col("height") - LEVELS).alias("height"), F.col("top").alias("digest"))
        self.nodes = self._linked(found) if found else None

    def _linked(self, found: list[DataFrame]) -> DataFrame:
        """Node rows with a link to their parents: tree -1 is that over the sources, whose leaf number t is the top of tree t."""
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        height = self.sources.select("tree", _height(F.col("n")).alias("height"))
        up = F.struct(F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.expr("pos div 3").alias("up_pos"))
        across = F.struct(F.lit(-1).cast("long").alias("up_tree"), F.lit(0).alias("up_level"), F.col("tree").alias("up_pos"))
        linked = rows.join(height, "tree", "left").withColumn("up", F.when(F.col("level") + 1 == F.col("height"), across).otherwise(up))
        return materialize(linked.select("tree", "level", "pos", "slot", "run", "up.*"), "merkle-nodes")

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof, folded, bent) in digests: proof is the string of all siblings from the leaf to the root,
        folded what the tampered leaf (else the leaf) and the siblings give."""
        low = f"least({LEVELS}, height)"
        steps, place = f"slice(array(0, 1, 2, 3), 1, {low})", "(i div element_at(array(1, 3, 9, 27), x + 1))"
        run, slot = _RUN.format(level="levels[x]", slot=place), f"({place} % 3)"
        fold, others = _H.format(_PLACED.format(run=run, k=slot, digest="f")), _OTHERS.format(run=run, k=slot)
        start = self.packs.select(
            F.col("tree").alias("own"), "pack", F.expr(f"if(height <= {LEVELS}, -1L, tree)").alias("tree"), F.expr(f"if(height <= {LEVELS}, 0, {LEVELS})").alias("level"), F.expr(f"if(height <= {LEVELS}, tree, pack)").alias("pos"),
            F.expr(f"""transform(items, (e, i) -> aggregate({steps}, coalesce(e.bent, e.digest), (f, x) -> {fold}))""").alias("folded"),
            F.expr("X''").alias("proof"), F.expr(f"if(height <= {LEVELS}, top, CAST(NULL AS BINARY))").alias("subroot"),
        )
        ended = materialize(start, "merkle-start")
        if self.nodes is not None:
            ended = self._climbed(ended)
        ended = ended.where((F.col("tree") == -1) & (F.col("level") == self.height)).select(F.col("own").alias("tree"), "pack", "folded", "proof", "subroot")
        own = F.expr(
            f"""transform(items, (e, i) -> named_struct('doc_id', e.doc_id, 'leaf', e.digest, 'bent', e.bent, 'folded', folded[i],
              'proof', concat(aggregate({steps}, X'', (a, x) -> concat(a, {others})), proof)))"""
        )
        return self.packs.join(ended, ["tree", "pack"]).select(own.alias("own"), "subroot").select(F.explode("own").alias("x"), "subroot").select("x.*", "subroot", F.lit(self.root).alias("root"))

    def _climbed(self, start: DataFrame) -> DataFrame:
        """The rows of the climb, one for each pack and level, written to the shared folder."""
        start.createOrReplaceTempView("merkle_start")
        self.nodes.createOrReplaceTempView("merkle_nodes")
        digest = "substring(n.run, 32 * n.slot + 1, 32)"
        sql = f"""
        WITH RECURSIVE climb AS (
          SELECT own, pack, tree, level, pos, folded, proof, subroot FROM merkle_start
          UNION ALL
          SELECT c.own, c.pack, n.up_tree, n.up_level, n.up_pos,
            transform(c.folded, f -> {_H.format(_PLACED.format(run="n.run", k="n.slot", digest="f"))}),
            concat(c.proof, {_OTHERS.format(run="n.run", k="n.slot")}),
            coalesce(c.subroot, CASE WHEN n.tree >= 0 AND n.up_tree = -1 THEN {_H.format("n.run")} END)
          FROM climb c JOIN merkle_nodes n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos)
        SELECT * FROM climb WHERE tree = -1 AND level = {self.height}"""
        before = self.spark.conf.get(_ROW_LIMIT)
        self.spark.conf.set(_ROW_LIMIT, "-1")  # the rows follow the data
        try:
            return materialize(self.spark.sql(sql), "merkle-climb")
        finally:
            self.spark.conf.set(_ROW_LIMIT, before)
            self.spark.catalog.dropTempView("merkle_start")
            self.spark.catalog.dropTempView("merkle_nodes")


def hex_of(column: str | Column) -> Column:
    return F.lower(F.hex(column))
