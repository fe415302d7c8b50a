"""The registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import context, graph
from ferrule.plans import answer_queries, chunk_queries, graph_queries, orphan_queries, search_queries, store_queries
from ferrule.plans import registry as R
from ferrule.runtime import checkpoint
from ferrule.streaming import ingest

_CATALOGS = [store_queries.CATALOG, chunk_queries.CATALOG, search_queries.CATALOG, graph_queries.CATALOG, answer_queries.CATALOG]


def flagship(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """Hybrid hits of the golden questions whose id ``every`` divides, one hop of neighbours, interleaved, cut to the budget, as prompts."""
    hits = search_queries.hybrid_hits(spark, sf_dir, every).select("query_id", F.col("row_id").alias("chunk_id"), F.col("rank").alias("pos"), F.lit("hybrid").alias("source"))
    hits = checkpoint(hits)  # a few rows per question, read three times below
    near = graph.expand_neighbors(hits.select("query_id", "chunk_id"), R.edges(spark, sf_dir), R.live_nodes(spark, sf_dir))
    near = near.select("query_id", "chunk_id", F.lit(0).alias("pos"), F.lit("graph_expand").alias("source"))
    placed = context.interleave(graph.merge_hits(hits, near))
    blocks = placed.join(R.chunks(spark, sf_dir), "chunk_id").select("query_id", "place", context.block().alias("block"))
    ctx = context.assembled(context.within_budget(blocks, "query_id", "place", "block"), "query_id", "place", "block")
    q = R.questions(spark, sf_dir).select(F.col("qa_id").alias("query_id"), "question", context.route(F.col("question")).alias("route"))
    return q.join(ctx, "query_id").select("query_id", "route", "n", context.prompt(F.col("route"), F.col("context"), F.col("question")).alias("prompt"))


def queries() -> dict:
    out = {"flagship": flagship, "stream_ingest": ingest.stream_ingest}
    for c in _CATALOGS:
        out |= c.queries
    return out | orphan_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    out = {}
    for c in _CATALOGS:
        out |= c.sql
    return out | orphan_queries.SQL
