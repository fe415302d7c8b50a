"""Session helpers: table access, checkpoints in the shared folder, parallelism."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset in a
    single-machine session, as in tests, a temporary folder is chosen; on a cluster
    its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "ferrule-checkpoints")
    return path


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, for spreading CPU-heavy stages of small inputs."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over the cluster for a CPU-heavy stage, where the scan gives it too few tasks.

    Few large files yield few tasks; a hash of ``keys`` spreads their rows. A scan of
    two tasks or more per slot is left as it is, so large inputs are not shuffled for it.
    """
    wanted = slots(df.sparkSession)
    if df.rdd.getNumPartitions() >= 2 * wanted:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted), *keys)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a context, where they cannot import it themselves."""
    sc = spark.sparkContext
    if getattr(sc, "_ferrule_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    # The driver serves this file to the executors; they do not read its folder.
    path = Path(tempfile.mkdtemp(prefix="ferrule-")) / "ferrule.zip"
    path.write_bytes(held.getvalue())
    sc.addPyFile(str(path))
    sc._ferrule_shipped = True
