"""References to records that do not exist (problem 3).

Parent keys are range-partitioned at boundaries taken from a bounded sample of
both sides; a task holds its range's parents as sorted arrays and probes batches of
references by binary search, vectorised. A range that a few popular keys fill with
references is answered by several tasks that each get the range's parents, so a key
with a third of all references does not make one task long.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import slots

#: Keys that the range boundaries are taken from, at most.
SAMPLE_KEYS = 20_000
#: Largest share of the sampled references that one task takes, in units of an even share.
HOT_FACTOR = 2
#: References that one task should get, about.
TASK_REFS = 500_000


def _boundaries(refs: DataFrame, parents: DataFrame, parts: int) -> tuple[list[str], list[int]]:
    """Upper boundaries of ranges and how many tasks share each range's references.

    Both sides give half of the sample each, so neither many parents nor many
    references of a range end up in one task.
    """
    half = SAMPLE_KEYS // 2
    picked = refs.select("key", F.xxhash64("key", "ref").alias("h")).orderBy("h", "key").limit(half)
    asked = sorted(r[0] for r in picked.select("key").collect())
    held = parents.select("key", F.xxhash64("key", "since").alias("h")).orderBy("h", "key").limit(half)
    keys = sorted(asked + [r[0] for r in held.select("key").collect()])
    bounds: list[str] = []
    for i in range(1, parts if keys else 1):
        b = keys[i * len(keys) // parts]
        if not bounds or b > bounds[-1]:
            bounds.append(b)
    even = max(1, len(asked)) / parts
    edges = [0, *(bisect.bisect_left(asked, b) for b in bounds), len(asked)]
    return bounds, [max(1, round((b - a) / (HOT_FACTOR * even))) for a, b in zip(edges, edges[1:], strict=False)]



def orphan_references(refs: DataFrame, parents: DataFrame, ref_id: str, key: str, written_at: str, parent_key: str, valid_from: str, valid_to: str, parts: int | None = None) -> DataFrame:
    """References whose key has no parent that lives when the reference is written.

    A parent row lives from ``valid_from`` (null: never) up to but not at ``valid_to``
    (null: for good). Result: ``ref_id, ref_key, written_at, kind``; ``kind`` is
    ``missing`` when no parent row has the key, ``late`` when all such rows begin
    after ``written_at``, else ``deleted``. Null and blank keys are no references;
    a reference without ``written_at`` is reported only when its key is ``missing``;
    repeated rows count once; keys compare exactly, by bytes. Other columns of either
    table are not read, so their names do not matter. Empty tables are allowed.
    """
    spark = refs.sparkSession
    r = refs.select(F.col(ref_id).alias("ref"), F.col(key).cast("string").alias("key"), F.unix_micros(F.col(written_at).cast("timestamp")).alias("at"))
    r = r.where(F.col("key").isNotNull() & (F.regexp_replace("key", r"\s+", "") != ""))
    p = parents.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).cast("string").alias("key"), F.unix_micros(F.col(valid_from).cast("timestamp")).alias("since"), F.unix_micros(F.col(valid_to).cast("timestamp")).alias("until"))
    parts = parts or max(slots(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), -(-r.count() // TASK_REFS))
    bounds, shares = _boundaries(r, p, parts)
    ranges = spark.sparkContext.broadcast((np.array(bounds, dtype=object), np.array(shares)))
    ref_type = refs.schema[ref_id].dataType.simpleString()

    def of_range(keys: pd.Series) -> pd.Series:
        edges = ranges.value[0]
        return pd.Series(np.searchsorted(edges, keys.to_numpy(dtype=object), side="right") if len(edges) else np.zeros(len(keys), int)).astype("int32")

    def share_of(range_: pd.Series, h: pd.Series) -> pd.Series:
        return (h % ranges.value[1][range_.to_numpy()]).astype("int32")

    def shares_of(range_: pd.Series) -> pd.Series:
        return pd.Series([list(range(int(n))) for n in ranges.value[1][range_.to_numpy()]])

    range_udf, share_udf, shares_udf = F.pandas_udf(of_range, "int"), F.pandas_udf(share_of, "int"), F.pandas_udf(shares_of, "array<int>")
    r = r.withColumn("range", range_udf("key")).withColumn("share", share_udf("range", F.pmod(F.xxhash64("ref"), F.lit(1 << 30))))
    p = p.distinct().withColumn("range", range_udf("key")).withColumn("share", F.explode(shares_udf("range")))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["key", "since"], kind="stable", na_position="last")
        known, since, until = right["key"].to_numpy(dtype=object), right["since"].to_numpy(float), right["until"].to_numpy(float)
        asked = left["key"].to_numpy(dtype=object)
        lo, hi = np.searchsorted(known, asked, side="left"), np.searchsorted(known, asked, side="right")
        at = left["at"].to_numpy(float)
        alive, early = np.zeros(len(left), bool), np.zeros(len(left), bool)
        for k in range(int((hi - lo).max(initial=0))):  # rows of a parent key, a few: it was deleted and came back
            has = lo + k < hi
            row = np.where(has, lo + k, 0)
            begun = has & (since[row] <= at) if len(since) else has
            early |= begun
            alive |= begun & (np.isnan(until[row]) | (until[row] > at)) if len(until) else begun
        miss = ~alive & (~np.isnan(at) | (hi == lo))
        kind = np.where(hi == lo, "missing", np.where(early, "deleted", "late"))
        return pd.DataFrame({"ref": left["ref"].to_numpy()[miss], "key": asked[miss], "at": left["at"].to_numpy()[miss], "kind": kind[miss]})

    found = r.groupBy("range", "share").cogroup(p.groupBy("range", "share")).applyInPandas(probe, f"ref {ref_type}, key string, at long, kind string")
    return found.distinct().select(F.col("ref").alias("ref_id"), F.col("key").alias("ref_key"), F.timestamp_micros("at").alias("written_at"), "kind")


def orphan_report(found: DataFrame, table_name: str) -> DataFrame:
    """Orphans per table, side, month of writing and kind; ``found`` also has ``side``."""
    month = F.date_format(F.date_trunc("month", "written_at"), "yyyy-MM")
    return found.groupBy(F.lit(table_name).alias("table_name"), "side", month.alias("month"), "kind").agg(F.count("*").alias("orphans"))
