"""Queries on dangling references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import orphans
from ferrule.runtime import table


def edge_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes")
    # Both sides of an edge in one pass: its two references carry the side in their id.
    ends = edges.select(F.explode(F.array(*(F.struct(F.struct("edge_id", F.lit(s).alias("side")).alias("ref"), F.col(c).alias("key"), F.col("written_at")) for s, c in (("source", "source_id"), ("target", "target_id"))))).alias("e")).select(F.concat_ws("|", F.col("e.ref.edge_id").cast("string"), F.col("e.ref.side")).alias("ref"), "e.key", "e.written_at")
    found = orphans.orphan_references(ends, nodes, "ref", "key", "written_at", "chunk_id", "indexed_at", "deleted_at")
    return found.select(F.split_part("ref_id", F.lit("|"), F.lit(1)).cast("long").alias("edge_id"), F.split_part("ref_id", F.lit("|"), F.lit(2)).alias("side"), "ref_key", "written_at", "kind")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_orphans(spark, sf_dir).select("edge_id", "side", "kind").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(edge_orphans(spark, sf_dir), "edges")


_FOUND = """
WITH refs AS (
  SELECT edge_id, 'source' AS side, source_id AS k, written_at FROM edges
  UNION SELECT edge_id, 'target', target_id, written_at FROM edges),
judged AS (
  SELECT r.edge_id, r.side, r.k, r.written_at, count(n.chunk_id) AS n,
         coalesce(bool_or(n.indexed_at <= r.written_at), false) AS early,
         coalesce(bool_or(n.indexed_at <= r.written_at AND (n.deleted_at IS NULL OR n.deleted_at > r.written_at)), false) AS alive
  FROM refs r LEFT JOIN nodes n ON n.chunk_id = r.k
  WHERE r.k IS NOT NULL AND regexp_replace(r.k, '\\s+', '', 'g') <> ''
  GROUP BY ALL),
found AS (
  SELECT edge_id, side, k, written_at, CASE WHEN n = 0 THEN 'missing' WHEN early THEN 'deleted' ELSE 'late' END AS kind
  FROM judged WHERE NOT alive AND (written_at IS NOT NULL OR n = 0))
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL = {
    "p3_found": _FOUND + "SELECT DISTINCT edge_id, side, kind FROM found",
    "p3_report": _FOUND + "SELECT 'edges' AS table_name, side, strftime(written_at, '%Y-%m') AS month, kind, count(*) AS orphans FROM found GROUP BY ALL",
}
