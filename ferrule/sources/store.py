"""Tables of the engine on parquet: upserts, deletes, purges and the log of finished work.

Pure functions give the new state of a table; ``TableStore`` writes it as a new
version and moves a pointer, as Spark refuses to overwrite what a plan reads.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule import schemas


def upsert(base: DataFrame, new: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """``base`` with the rows of ``new``: a new row replaces the one of its key, of several the last by ``order``.

    Rows with a null key are dropped from ``new``. Without ``order`` equal keys are settled by all columns.
    """
    order = order or [F.col(c) for c in sorted(new.columns) if not isinstance(new.schema[c].dataType, T.MapType)]
    w = Window.partitionBy(key).orderBy(*[c.desc_nulls_last() for c in order])
    last = new.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return base.join(last.select(key), key, "left_anti").select(*base.columns).unionByName(last.select(*base.columns))


def with_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks that can be stored: both vectors are there."""
    return chunks.where("vector_768 is not null and vector_128 is not null")


def without_tenant(table: DataFrame, repo: str, column: str = "repo_name") -> DataFrame:
    """A table without a repository's rows; rows without a repository stay."""
    return table.where(F.col(column).isNull() | (F.col(column) != repo))


def without_tenant_edges(edges: DataFrame, repo: str) -> DataFrame:
    """Edges whose source does not belong to the repository."""
    return edges.where(F.col("source_id").isNull() | ~F.startswith("source_id", F.lit(f"{repo}::")))


def detached(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the repository's nodes and every edge at one of them."""
    gone = nodes.where(F.col("repo_name") == repo).select("chunk_id").distinct()
    left = edges
    for end in ("source_id", "target_id"):
        left = left.join(gone.select(F.col("chunk_id").alias(end)), end, "left_anti").select(*edges.columns)
    return without_tenant(nodes, repo), left


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (``repo_name, path``) that the log (``repo_name, path``) does not have."""
    return files.join(done.select("repo_name", "path").distinct(), ["repo_name", "path"], "left_anti")


def wal_key(repo: Column, op: Column, kwargs: Column) -> Column:
    """``repo::op::k=v,...`` with the keys sorted."""
    pairs = F.transform(F.array_sort(F.map_entries(kwargs)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("::", repo, op, F.array_join(pairs, ","))


class TableStore:
    """Versioned parquet tables under one folder, partitioned by ``repo_name`` where they have it.

    ``root`` is a folder that the driver and all executors mount.
    """

    TABLES = {"chunks": schemas.CHUNKS, "nodes": schemas.NODES, "edges": schemas.EDGES}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    def _pointer(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.current")

    def exists(self, name: str) -> bool:
        return os.path.exists(self._pointer(name))

    def read(self, name: str) -> DataFrame:
        """The table's current version; empty with the declared schema if there is none."""
        schema = self.TABLES[name]
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        with open(self._pointer(name)) as f:
            return self.spark.read.schema(schema).parquet(os.path.join(self.root, f.read().strip()))

    def write(self, name: str, df: DataFrame) -> None:
        """The whole new state as a new version; readers of the old one are not disturbed."""
        version = f"{name}-{time.time_ns()}-{uuid.uuid4().hex[:6]}"
        schema = self.TABLES[name]
        out = df.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
        writer = out.write.mode("overwrite")
        (writer.partitionBy("repo_name") if "repo_name" in schema.names else writer).parquet(os.path.join(self.root, version))
        staged = self._pointer(name) + ".new"
        with open(staged, "w") as f:
            f.write(version)
        os.replace(staged, self._pointer(name))

    def compact(self, name: str, files: int = 1) -> None:
        """The same rows in fewer files."""
        self.write(name, self.read(name).coalesce(files))

    def add_chunks(self, chunks: DataFrame) -> None:
        self.write("chunks", upsert(self.read("chunks"), with_vectors(chunks), "chunk_id"))
        nodes = chunks.select(*schemas.NODES.names)
        self.write("nodes", upsert(self.read("nodes"), nodes, "chunk_id"))

    def add_edges(self, edges: DataFrame) -> None:
        from ferrule.operators.graph import checked_edges

        merged = self.read("edges").unionByName(checked_edges(edges, self.read("nodes"))).distinct()
        self.write("edges", merged)

    def purge(self, repo: str) -> None:
        nodes, edges = detached(self.read("nodes"), self.read("edges"), repo)
        chunks = without_tenant(self.read("chunks"), repo)
        for name, df in (("edges", edges), ("nodes", nodes), ("chunks", chunks)):
            self.write(name, df)


class WriteLog:
    """An append-only log of finished operations, read back as the set of their keys."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def record(self, entries: DataFrame) -> None:
        """Adds entries (``repo, op, kwargs``) after their work has succeeded."""
        entries.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6).select(*schemas.WAL.names).write.mode("append").json(self.path)

    def entries(self) -> DataFrame:
        """All readable entries; corrupt lines are skipped."""
        if not os.path.exists(self.path):
            return self.spark.createDataFrame([], schemas.WAL)
        return self.spark.read.schema(schemas.WAL).option("mode", "DROPMALFORMED").json(self.path).where("repo is not null and op is not null")

    def done(self) -> DataFrame:
        return self.entries().select(wal_key(F.col("repo"), F.col("op"), F.col("kwargs")).alias("key")).distinct()

    def clear(self, repo: str = "") -> None:
        """Forgets a repository's entries, or all."""
        kept = self.entries().where(F.lit(bool(repo)) & (F.col("repo") != repo))
        staged = self.path + ".new"
        kept.write.mode("overwrite").json(staged)
        old = self.path + ".old"
        if os.path.exists(self.path):
            os.replace(self.path, old)
        os.replace(staged, self.path)
        shutil.rmtree(old, ignore_errors=True)
