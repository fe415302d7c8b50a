"""Filling fixed-capacity containers with items (problem 8).

Sum-of-squares packing: an item goes where the sum over all residual gaps of the
squared number of open containers with that gap becomes smallest, which keeps the
gaps varied so that later items find one that fits. Every part of the data packs its
items on its own; containers that stay poorly filled there are opened again and
packed anew with those of other parts, in rounds of as many parts as the items left
need, until one part holds them all or a round settles next to nothing (items that
fit with no others stay alone wherever they are). Items of a full capacity, and the full pieces of longer ones, need no packing.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import checkpoint, spread

#: Folder of the public tokenizers' vocabularies, and the one used unless told otherwise.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Tokenizers that this process has built, by vocabulary.
BUILT: dict[str, object] = {}


def encoder(path: str, ranks: dict[bytes, int]):
    """The tokenizer of a vocabulary, built once a process."""
    import tiktoken

    if path not in BUILT:
        BUILT[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return BUILT[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``<id_col>, n_tokens`` of each document, once per id; a null text has 0 tokens, null ids are left out.

    The driver reads the vocabulary and broadcasts it, some 50,000 ranks; workers need no such file.
    """
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in it:
            enc = enc or encoder(path, ranks.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], ["id", "n_tokens"])

    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(src, "id").mapInArrow(run, f"id {kind}, n_tokens long").groupBy("id").agg(F.max("n_tokens").alias("n_tokens")).withColumnRenamed("id", id_col)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, in the order given, and the gap each container is left with."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, gaps = np.zeros(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum for a container of gap g: one leaves count[g], one enters count[g - s]; a full one counts nowhere.
        old, new = count[s:], count[: capacity + 1 - s]
        change = np.where(old > 0, 2 - 2 * old + 2 * new, np.iinfo(np.int64).max)
        if old[0] > 0:
            change[0] = 1 - 2 * old[0]
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = int(change.argmin())  # of equals the smallest remaining gap
        if change[g] <= fresh and old[g] > 0:
            g += s
            c = held[g].pop()
            count[g] -= 1
            gaps[c] = g - s
        else:
            c, g = len(gaps), capacity
            gaps.append(capacity - s)
        if g > s:
            held[g - s].append(c)
            count[g - s] += 1
        where[i] = c
    return where, np.array(gaps, np.int64)


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int, part_items: int = 50_000, loose: float = 0.02, gain: float = 0.1) -> DataFrame:
    """Containers of at most ``capacity`` for items of whole, not negative sizes.

    Result: ``<id_col>, piece, start, size, container``; an item within capacity has
    the one piece 0, a longer one is cut into full pieces and a rest, each piece
    covering ``[start, start + size)`` of it. Items of size 0 or null fit anywhere and
    get the container null; negative sizes raise an error. Ids should be distinct; equal sizes are no matter.
    ``part_items``: items packed together, by one task, in every round; ``loose``: share
    of a container that may stay empty before it is packed again in the next round;
    ``gain``: share of its items that a round has to settle for another to follow.
    """
    src = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("n"))
    src = src.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("negative size"))).otherwise(F.col("n")))
    kind = sizes.schema[id_col].dataType.simpleString()
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("long")
    pieces = src.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("size"))
    ready = pieces.where((F.col("size") >= capacity) | (F.col("size") == 0))
    done = ready.select("id", "piece", "start", "size", F.when(F.col("size") > 0, F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("."), F.col("piece").cast("string"))).alias("container"))
    rest = pieces.where((F.col("size") > 0) & (F.col("size") < capacity))
    left, level, stuck = rest.count(), 0, False

    def filler(name: str, final: bool):
        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
            where, gaps = sum_of_squares(pdf["size"].to_numpy(), capacity)
            keep = np.ones(len(pdf), bool) if final else gaps[where] <= loose * capacity
            ids = [f"{name}.{p}.{c}" if k else None for p, c, k in zip(pdf["part"], where, keep, strict=True)]
            return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "size": pdf["size"], "container": ids})

        return fill

    while True:
        # Parts follow from the items that are left, so none outgrows a task, and each has a task of its own.
        parts = max(1, -(-left // part_items))
        final = parts == 1 or stuck
        out = rest.withColumn("part", F.pmod(F.xxhash64("id", "piece", F.lit(level)), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
        out = out.groupBy("part").applyInPandas(filler(f"p{level}", final), f"id {kind}, piece long, start long, size long, container string")
        if final:
            return done.unionByName(out).withColumnRenamed("id", id_col)
        out = checkpoint(out)
        done = done.unionByName(out.where("container is not null"))
        rest = out.where("container is null").drop("container")
        before, left, level = left, rest.count(), level + 1
        if not left:
            return done.withColumnRenamed("id", id_col)
        stuck = left > (1 - gain) * before


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens and the share of their room that is used, against the fewest containers that could do."""
    c = packed.where("container is not null").groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    c = c.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most_used"), F.sum("n").alias("pieces"))
    return c.select("containers", "pieces", "tokens", "most_used", F.ceil(F.col("tokens") / capacity).alias("fewest"), (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))
