"""A registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, with SQL where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(q: Query) -> Query:
            self.queries[q.__name__] = q
            if sql:
                self.sql[q.__name__] = sql
            return q

        return keep


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, repeated rows once."""
    return table(spark, d, "chunks").where("chunk_id is not null").dropDuplicates(["chunk_id"])


def live_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that are not deleted, by id."""
    return table(spark, d, "nodes").where("deleted_at is null and chunk_id is not null").select("chunk_id", "repo_name").distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").select("source_id", "target_id", "edge_type").distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_files").where("file_id is not null").dropDuplicates(["file_id"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_pairs").where("qa_id is not null").dropDuplicates(["qa_id"])


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id is not null").dropDuplicates(["doc_id"])


CHUNKS_SQL = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL)"
NODES_SQL = "n AS (SELECT DISTINCT chunk_id, repo_name FROM nodes WHERE deleted_at IS NULL AND chunk_id IS NOT NULL)"
EDGES_SQL = "e AS (SELECT DISTINCT source_id, target_id, edge_type FROM edges)"
FILES_SQL = "f AS (SELECT DISTINCT ON (file_id) * FROM raw_files WHERE file_id IS NOT NULL)"
QA_SQL = "q AS (SELECT DISTINCT ON (qa_id) * FROM qa_pairs WHERE qa_id IS NOT NULL)"
DOCS_SQL = "d AS (SELECT DISTINCT ON (doc_id) * FROM documents WHERE doc_id IS NOT NULL)"
