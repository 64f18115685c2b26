"""Entity resolution on relations: survivors, remaps, components over shared keys."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.components import connected_components
from lectern.operators.groups import in_groups


def components_by_key(rows: DataFrame, record: str, key: str) -> DataFrame:
    """(node, component) of records that share keys: each record is linked to its key's smallest record only."""
    hubs = rows.groupBy(key).agg(F.min(record).alias("hub"))
    return connected_components(rows.join(hubs, key), record, "hub")


def survivors(rows: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """Every row with the id of its group's first row."""
    return rows.select(id_col, F.first(id_col).over(Window.partitionBy(*keys).orderBy(*order)).alias("survivor"))


def remap_edges(edges: DataFrame, kept: DataFrame, old: str, new: str) -> DataFrame:
    """Edges between survivors, without loops and repeats; endpoints without an entry stay."""
    a, b = kept.select(F.col(old).alias("src"), F.col(new).alias("_s")), kept.select(F.col(old).alias("dst"), F.col(new).alias("_d"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").withColumns({"src": F.coalesce("_s", "src"), "dst": F.coalesce("_d", "dst")}).drop("_s", "_d")
    return moved.where("src <> dst").distinct().select(*edges.columns)


def one_direction(edges: DataFrame, order: list[Column]) -> DataFrame:
    """Of edges between the same two nodes the first in order."""
    pair = [F.least("src", "dst"), F.greatest("src", "dst")]
    ranked = edges.withColumn("_r", F.row_number().over(Window.partitionBy(*pair).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r")


def merge_title_years(rows: DataFrame, gap: int = 2) -> DataFrame:
    """(id, survivor) of rows(id, title_key, year, doi, cites): rows in order of id meet the records so far of the same
    title within ``gap`` years, or of the same DOI; the one with more citations survives and stands for both.

    Order matters, so rows run in sequence, but only inside one component of shared titles and DOIs.
    """
    keys = rows.select("id", F.explode(F.array_compact(F.array(F.concat(F.lit("t:"), "title_key"), F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("d:"), "doi"))))).alias("key"))
    parts = rows.join(components_by_key(keys, "id", "key").withColumnRenamed("node", "id"), "id")

    def work(group: list[tuple]) -> list[tuple]:
        alive: list[tuple] = []
        by_title, by_doi, into = defaultdict(set), defaultdict(set), {}
        for row in sorted(group, key=lambda r: r[1]):
            _, i, title, year, doi, cites = row

            def same(k: int, year=year) -> bool:
                other = alive[k][3]
                return year is None or other is None or abs(year - other) <= gap

            near = min((k for k in by_title[title] if same(k)), default=None) if title is not None else None
            match = min((k for k in (near, min(by_doi[doi], default=None) if doi else None) if k is not None), default=None)
            if match is None:
                match = len(alive)
                alive.append(row)
            else:
                held = alive[match]
                kept, gone = (row, held) if cites is not None and held[5] is not None and cites > held[5] else (held, row)
                into[gone[1]] = kept[1]
                if kept is held:
                    continue
                by_title[held[2]].discard(match)
                by_doi[held[4]].discard(match)
                alive[match] = row
            by_title[title].add(match)
            if doi:
                by_doi[doi].add(match)

        def final(i):
            path = []
            while i in into:
                path.append(i)
                i = into[i]
            into.update(dict.fromkeys(path, i))
            return i

        return [(r[1], final(r[1])) for r in group]

    return in_groups(parts.select("component", "id", "title_key", "year", "doi", "cites"), work, rows.sparkSession.createDataFrame([], "id long, survivor long"))
