"""Writers of exports. Spark's commit protocol makes each write atomic; an existing path is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from lectern.functions.text import formula_guard


def csv_export(df: DataFrame, path: str, texts: list[str]) -> None:
    """Cells that a spreadsheet would run as formulas are guarded; lists are joined by semicolons."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    safe = df.withColumns({c: F.array_join(c, "; ") for c in lists} | {c: formula_guard(F.col(c)) for c in texts})
    safe.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', quoteAll=True, lineSep="\n")


def json_export(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path, ignoreNullFields=False)


def atom_export(df: DataFrame, path: str) -> None:
    df.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").mode("errorifexists").save(path)


def detail_shards(df: DataFrame, path: str, id_col: str) -> None:
    """256 shards by the first two digits of a hexadecimal id, sorted by id inside each; a shard of any size is
    written by as many tasks as its rows ask for."""
    prefixed = df.withColumn("prefix", F.substring(id_col, 1, 2))
    prefixed.hint("rebalance", F.col("prefix")).sortWithinPartitions("prefix", id_col).write.mode("errorifexists").partitionBy("prefix").parquet(path)


def append_history(run: DataFrame, path: str) -> None:
    run.write.mode("append").json(path)


def digest_lines(df: DataFrame, order: list[Column], line: Column, most: int) -> DataFrame:
    """The first lines of a ranked digest."""
    return df.orderBy(*order).limit(most).select(line.alias("line"))


def bibtex_entries(kind: str, key: Column, fields: dict[str, Column]) -> Column:
    body = F.concat_ws(",\n  ", *(F.concat(F.lit(f"{n} = {{"), c, F.lit("}")) for n, c in fields.items()))
    return F.concat(F.lit(f"@{kind}{{"), key, F.lit(",\n  "), body, F.lit("\n}"))


def email_digest(df: DataFrame, order: list[Column], line: Column, most: int) -> DataFrame:
    """One row: the first lines, numbered, as plain text and as an HTML list."""
    place = F.row_number().over(Window.orderBy(*order))
    top = df.orderBy(*order).limit(most).select(place.alias("k"), line.alias("line"))
    first = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))
    told = F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))

    def escaped(x: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(sign), F.lit(name))
        return x

    return first.select(F.array_join(told, "\n").alias("plain"), F.concat(F.lit("<ul>"), F.array_join(F.transform(told, lambda x: F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))), ""), F.lit("</ul>")).alias("html"))


def audit_sheets(rows: DataFrame, group: str) -> DataFrame:
    """(group, sheet): a Markdown table of rows(group, node, verdict) in order of node, and how many are unset."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("node", "verdict"))), lambda r: F.concat(F.lit("| "), r["node"].cast("string"), F.lit(" | "), r["verdict"], F.lit(" |")))
    head = F.array(F.lit("| node | verdict |"), F.lit("| --- | --- |"))
    unset = F.concat(F.count_if(F.col("verdict") == "").cast("string"), F.lit(" unset"))
    return rows.groupBy(group).agg(F.array_join(F.concat(head, lines, F.array(unset)), "\n").alias("sheet"))


def _canonical(column: Column, kind: DataType) -> Column:
    """The same value with its fields in order of name, at every level."""
    if isinstance(kind, StructType):
        return F.struct(*(_canonical(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _canonical(x, kind.elementType))
    return column


def canonical_sha256(df: DataFrame, column: str) -> Column:
    """SHA-256 of a column as JSON with its keys in order."""
    return F.sha2(F.to_json(_canonical(F.col(column), df.schema[column].dataType)).cast("binary"), 256)
