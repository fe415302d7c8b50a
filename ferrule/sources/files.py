"""File sources: directories, git clones, JSON lines."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule import schemas

# Directories that are skipped, languages by extension, the size limit.
IGNORED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "eggs", "test", "tests", "test_*")
EXTENSIONS = {".py": "python", ".js": "javascript", ".ts": "typescript"}
MAX_BYTES = 1 << 20


def language_of(path: Column) -> Column:
    """The language by extension, small or capital letters; ``unknown`` for others."""
    out = F.lit("unknown")
    for ext, lang in EXTENSIONS.items():
        out = F.when(F.endswith(F.lower(path), F.lit(ext)), F.lit(lang)).otherwise(out)
    return out


def admitted(path: Column, content: Column, size: Column | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """Whether a file is taken: extension, size, no ignored or dotted directory on its path, not blank."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    clear = F.forall(dirs, lambda d: ~d.isin(*IGNORED_DIRS) & (~F.startswith(d, F.lit(".")) | (d == "")))
    size = F.octet_length(content) if size is None else size
    return (language_of(path) != "unknown") & clear & (size > 0) & (size <= max_bytes) & (F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", "") != "")


def directory(spark: SparkSession, root: str, repo_name: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Source files below ``root`` as ``raw_files`` rows; bytes that are no UTF-8 are dropped, links and unreadable files skipped."""
    root = root.rstrip("/")

    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode("utf-8", "ignore"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    rel = F.regexp_replace("path", r"^(file:)?/*" + root.lstrip("/").replace(".", r"\.") + "/", "")
    files = files.where((F.col("length") > 0) & (F.col("length") <= max_bytes)).withColumn("rel", rel).where(language_of(F.col("rel")) != "unknown")
    files = files.select(F.lit(repo_name).alias("repo_name"), F.col("rel").alias("path"), F.pandas_udf(decode, "string")("content").alias("content"), language_of(F.col("rel")).alias("language"), F.col("length").alias("size_bytes"))
    return files.where(admitted(F.col("path"), F.col("content"), F.col("size_bytes"), max_bytes))


@contextmanager
def cloned(url: str, timeout: int = 60, parent: str | None = None) -> Iterator[str]:
    """A shallow clone of one branch in a temporary folder, removed afterwards; prompts are off.

    ``parent`` should be a folder that all executors share where the engine runs on a cluster.
    """
    folder = tempfile.mkdtemp(prefix="clone-", dir=parent)
    try:
        subprocess.run(["git", "clone", "--depth", "1", "--single-branch", url, folder], check=True, timeout=timeout, capture_output=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Question rows from JSON lines, blank and broken lines skipped; a missing file or no row raise an error."""
    df = spark.read.schema(schemas.GOLDEN).option("mode", "DROPMALFORMED").json(path)
    if df.isEmpty():
        raise ValueError(f"no questions in {path}")
    return df


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_document(value: dict, path: str) -> None:
    """One small document, indented, as a summary is."""
    with open(path, "w") as f:
        json.dump(value, f, indent=2, default=str)


def append_documents(docs: DataFrame | None, spark: SparkSession, rows: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """In-memory documents with free-form metadata, added to those there are."""
    schema = T.StructType([T.StructField("content", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
    new = spark.createDataFrame(rows, schema)
    return new if docs is None else docs.unionByName(new)
