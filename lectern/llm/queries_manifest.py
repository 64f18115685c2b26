"""Registered query of the dataset manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import merkle
from lectern.llm.common import table


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.Manifest(table(spark, sf_dir, "documents")).proofs()
    digests = [merkle.hex_of(c).alias(c) for c in ("leaf", "subroot", "root")]
    return found.select(
        "doc_id", *digests, F.sha2(merkle.hex_of("proof").cast("binary"), 256).alias("proof_sha256"),
        merkle.hex_of("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def _part(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: A CRC-32 over the decimal id's bytes, bit by bit; levels, runs of siblings and the climb by recursion.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS bare,
    list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN bare ELSE leaf END AS bent FROM d),
lv AS (SELECT 0 AS level, source, pos, leaf AS digest, n FROM p
  UNION ALL SELECT level + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY level, source, pos // 3, n),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (SELECT 0 AS level, pos, subroot AS digest, n FROM s
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tv WHERE n > 1 GROUP BY level, pos // 3, n),
runs AS (SELECT false AS top, source, level, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM lv WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT true, NULL, level, pos // 3, list(digest ORDER BY pos) FROM tv WHERE n > 1 GROUP BY ALL),
start AS (SELECT p.doc_id, p.source, p.pos AS row, p.leaf, p.bent, s.subroot, s.pos AS top_pos, s.n AS top_n, p.pos, p.n FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source),
c AS (SELECT source, row, n = 1 AS top, 0 AS level, CASE WHEN n = 1 THEN top_pos ELSE pos END AS pos, CASE WHEN n = 1 THEN top_n ELSE n END AS n, top_pos, top_n, bent AS folded, '' AS proof FROM start
  UNION ALL
  SELECT c.source, c.row, c.top OR c.n <= 3, CASE WHEN c.top OR c.n > 3 THEN c.level + 1 ELSE 0 END, CASE WHEN c.top OR c.n > 3 THEN c.pos // 3 ELSE c.top_pos END, CASE WHEN c.top OR c.n > 3 THEN (c.n + 2) // 3 ELSE c.top_n END, c.top_pos, c.top_n,
    sha256(array_to_string(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i = c.pos % 3 + 1 THEN c.folded ELSE ds[i] END), '')),
    c.proof || array_to_string(list_filter(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i = c.pos % 3 + 1 THEN '' ELSE ds[i] END), lambda x: x <> ''), '')
  FROM c JOIN runs ON runs.top = c.top AND runs.source IS NOT DISTINCT FROM (CASE WHEN c.top THEN NULL ELSE c.source END) AND runs.level = c.level AND runs.run = c.pos // 3
  WHERE c.n > 1)
SELECT start.doc_id, leaf, subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.digest AS verified
FROM start JOIN c ON start.source IS NOT DISTINCT FROM c.source AND start.row = c.row AND c.top AND c.n = 1, (SELECT digest FROM tv WHERE n = 1) r
"""
