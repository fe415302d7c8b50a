"""Continuous ingestion of files with Structured Streaming (beyond what a batch run needs).

A file source is read as far as there is input, rows are keyed by the hash of their
content, and each micro-batch adds the rows whose key the target lacks. The
checkpoint is the log of what was read; the target's own keys make retries harmless,
so no state grows with the stream.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.runtime import shared_dir


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_ingest(spark: SparkSession, source: str, schema: T.StructType, keys: list[str], target: str, state: str) -> None:
    """Appends to the parquet table ``target`` every row of ``source`` whose keys and content hash it lacks.

    Rows with a null key are left out; repeated rows count once. ``state`` holds the
    stream's checkpoint. Ends when there is no more input.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    stream = stream.where(" and ".join(f"`{k}` is not null" for k in keys))

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("row_hash", F.sha2(F.to_json(F.struct(*batch.columns)), 256)).dropDuplicates([*keys, "row_hash"])
        if _exists(spark, target):
            rows = rows.join(spark.read.parquet(target).select(*keys, "row_hash"), [*keys, "row_hash"], "left_anti")
        rows.write.mode("append").parquet(target)

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table ingested as a stream, summed up by type."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parquet"
    # A streaming source is a folder; a table that is one file is read through a glob of its own name.
    run_ingest(spark, source if os.path.isdir(source) else f"{sf_dir}/event[s].parquet", schema, ["event_id"], f"{root}/table", f"{root}/state")
    return spark.read.parquet(f"{root}/table").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
