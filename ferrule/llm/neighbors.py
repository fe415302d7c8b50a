"""Most similar vectors for every vector (problem 1).

A forest of random-projection trees is fitted on a bounded sample: a node projects on
the directions of many random members at once, not on one line, and has a branch for
each; a vector belongs to the branch it reaches furthest along. Near vectors lie far
along the same few of many directions, where a chain of halvings would part them at
one level or another, the more surely the more levels there are. Every vector descends
all trees at once: one priority queue per vector, shared by the trees, holds the leaves
of its open branches ordered by nearness, and its best leaves are the ones searched.
Trees that need more leaves than the sample has rows grow on: each leaf draws a sample
of its own and is split again, until leaves are as small as wanted. Within a leaf all
members are compared exactly, block by block; a leaf that is much larger all the same
is shared out by pairs of its parts. The best partners of all leaves are merged.

Only distinct directions travel: a task sends one vector per direction, however
many rows share it, so copies of one vector never pile up in a leaf. Vectors
travel once per searched leaf in compressed blocks, as 8-bit integers where these
hold them without loss and as 32-bit floats otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows on which the trees, or the further levels of a leaf, are fitted, at most. Every row is indexed.
SAMPLE_ROWS = 16_384
#: Levels that a sample fits: each leaf has a row of it as its centre.
FITTED_LEVELS = 13
#: Leaves of a tree that are met without cells.
FLAT = 64
#: Members that a leaf may have for one task to compare them all; more are shared out by pairs of parts.
HOT_LEAF = 10_000
#: Vectors that a search task is sent, on average.
TASK_VECTORS = 8_000


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int) -> list[Tree]:
    """Per tree the centres of its cells, those of its leaves, and the cell of each leaf.

    A tree has 2 ** ``depth`` leaves, as far as the sample has distinct rows. Their
    centres are rows of the sample, others in each tree as long as these last. More
    than ``FLAT`` leaves are reached by cells, half of the levels up, whose centres
    begin as rows too and move to the middle of the rows nearest to them.
    """
    rng, forest = np.random.default_rng(seed), []
    rows = np.sort(np.unique(direction_keys(sample), return_index=True)[1]) if len(sample) else np.zeros(0, np.int64)
    order, leaves = rng.permutation(rows), min(2**depth, max(1, len(rows)))
    for t in range(trees):
        centres = sample[order.take(range(t * leaves, (t + 1) * leaves), mode="wrap")] if len(rows) else unit(rng.normal(size=(1, sample.shape[1])).astype(np.float32))
        if leaves <= FLAT:
            forest.append((centres[:1], centres, np.zeros(leaves, np.int64)))
            continue
        cells = sample[rng.choice(rows, 2 ** ((depth + 1) // 2), replace=False)]
        for _ in range(3):
            nearest = (sample @ cells.T).argmax(1)
            middle = cells.copy()
            np.add.at(middle, nearest, sample)
            cells = unit(middle)
        forest.append((cells, centres, (centres @ cells.T).argmax(1)))
    return forest


def best_leaves(vectors: np.ndarray, forest: list[Tree], probes: int) -> np.ndarray:
    """The ``probes`` leaves of the forest whose centres are nearest to each row; ids count tree by tree.

    Each row opens the quarter of a tree's cells that is nearest to it. The leaves of
    an open cell enter the row's queue, which all trees share and which keeps the best.
    The queues of all rows are kept at once, a cell at a time.
    """
    n, above, queues = len(vectors), 0, []
    for cells, centres, cell_of in forest:
        wide = math.ceil(len(cells) / 4)
        opened = np.argpartition(-(vectors @ cells.T), wide - 1, 1)[:, :wide] if len(cells) > 1 else np.zeros((n, 1), np.int64)
        near, ids = np.full((n, wide, probes), -2, np.float32), np.full((n, wide, probes), -1, np.int64)
        rows, slots = np.divmod(np.argsort(opened, axis=None, kind="stable"), wide)
        ends = np.searchsorted(opened[rows, slots], np.arange(len(cells) + 1))
        order = np.argsort(cell_of, kind="stable")
        starts = np.searchsorted(cell_of[order], np.arange(len(cells) + 1))
        for c in range(len(cells)):
            mine, r, s = order[starts[c] : starts[c + 1]], rows[ends[c] : ends[c + 1]], slots[ends[c] : ends[c + 1]]
            if not len(mine) or not len(r):
                continue
            at = vectors[r] @ centres[mine].T
            take = np.argpartition(-at, probes - 1, 1)[:, :probes] if len(mine) > probes else np.tile(np.arange(len(mine)), (len(r), 1))
            near[r, s, : take.shape[1]], ids[r, s, : take.shape[1]] = np.take_along_axis(at, take, 1), mine[take] + above
        queues.append((near.reshape(n, -1), ids.reshape(n, -1)))
        above += len(centres)
    near, ids = np.concatenate([q for q, _ in queues], 1), np.concatenate([i for _, i in queues], 1)
    return np.take_along_axis(ids, np.argsort(-near, axis=1, kind="stable")[:, : min(probes, above)], 1)


def pack(block: np.ndarray) -> bytes:
    """Compressed rows, exact: 8-bit integers over a power of two where these are enough."""
    for power in (8, 7, 10, 12):
        scaled = block * np.float32(2**power)
        if np.abs(scaled).max(initial=0) <= 127 and np.array_equal(scaled, np.rint(scaled)):
            return bytes([power]) + zstandard.compress(scaled.astype(np.int8).tobytes(), 1)
    return b"\0" + zstandard.compress(np.ascontiguousarray(block, np.float32).tobytes(), 1)


def unpack(data: bytes, dim: int) -> np.ndarray:
    raw = zstandard.decompress(data[1:])
    if data[0]:
        return np.frombuffer(raw, np.int8).reshape(-1, dim).astype(np.float32) / np.float32(2 ** data[0])
    return np.frombuffer(raw, np.float32).reshape(-1, dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)).astype(np.float32)[:, None]


def direction_keys(vectors: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's direction, the same for multiples by a power of two."""
    scaled = np.ascontiguousarray(vectors / np.abs(vectors).max(axis=1, keepdims=True) + np.float32(0), np.float32)
    return np.array([xxhash.xxh3_64_intdigest(row) for row in scaled], np.uint64).view(np.int64)


def eligible(batch: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of the rows that have ``dim`` finite values, not all zero."""
    ids, vec = batch.column(0), batch.column(1)
    mask = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(vec), -1), dim), ids.is_valid())
    ids, vec = ids.filter(mask), vec.filter(mask)
    values = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    sound = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return ids.filter(pa.array(sound)), values[sound]


def leaf_partners(keys: np.ndarray, vectors: np.ndarray, k: int, least: float, parts: tuple[np.ndarray, int, int] | None = None, block: int = 1024) -> pd.DataFrame:
    """For every member of a leaf its ``k`` best other members with a cosine of ``least`` or more.

    ``parts``: the part of each member, and the two parts that are compared here.
    """
    if parts and parts[1] != parts[2]:
        order = np.argsort(parts[0] != parts[1], kind="stable")
        keys, vectors = keys[order], vectors[order]
        split = int((parts[0] == parts[1]).sum())
    else:
        split = 0
    n = len(keys)
    best = np.full((n, k), -2, np.float32)
    who = np.zeros((n, k), np.int64)

    def offer(start: int, sims: np.ndarray, first: int) -> None:
        """Takes over what beats a row's present kth best; after the first blocks that is little."""
        mine = slice(start, start + len(sims))
        r, c = np.nonzero(sims >= np.maximum(best[mine, -1], np.float32(least - 1e-5))[:, None])
        if not len(r):
            return
        if len(r) > 8 * k * len(sims):
            take = np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]
            r, c = np.repeat(np.arange(len(sims)), take.shape[1]), take.ravel()
        value = sims[r, c]
        order = np.lexsort((-value, r))
        r, c, value = r[order], c[order], value[order]
        hot, begin, count = np.unique(r, return_index=True, return_counts=True)
        rank = np.arange(len(r)) - np.repeat(begin, count)
        keep, row = rank < k, np.repeat(np.arange(len(hot)), count)
        score, ids = np.full((len(hot), k), -2, np.float32), np.zeros((len(hot), k), np.int64)
        score[row[keep], rank[keep]], ids[row[keep], rank[keep]] = value[keep], c[keep] + first
        at = hot + start
        score, ids = np.concatenate([best[at], score], 1), np.concatenate([who[at], ids], 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best[at], who[at] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    for i in range(0, split or n, block):
        for j in range(split or i, n, block):
            sims = vectors[i : min(i + block, split or n)] @ vectors[j : j + block].T
            if i == j:
                np.fill_diagonal(sims, -2)
            offer(i, sims, j)
            if i != j:
                offer(j, sims.T, i)
    for i in range(0, n, block):  # the same pair has the same cosine in every leaf, whatever its blocks
        both = np.einsum("ij,ikj->ik", vectors[i : i + block], vectors[who[i : i + block]])
        best[i : i + block] = np.where(best[i : i + block] > -2, both, -2)
    near = np.abs(best - least) < 1e-5
    if near.any():  # on the border, decide in double precision
        r, c = np.nonzero(near)
        a, b = vectors[r].astype(np.float64), vectors[who[r, c]].astype(np.float64)
        exact = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        best[r, c] = np.where(exact >= least - 1e-9, np.maximum(exact, least), -2)
    some = np.flatnonzero((best >= least).any(axis=1))
    good = best[some] >= least
    return pd.DataFrame({"dir": keys[some], "partners": pd.Series([keys[w[g]].tolist() for w, g in zip(who[some], good, strict=True)], dtype=object), "cosines": pd.Series([b[g].tolist() for b, g in zip(best[some], good, strict=True)], dtype=object)})


BLOCKS = pa.schema([("leaf", pa.int64()), ("dirs", pa.binary()), ("block", pa.binary())])


def blocks_of(leaves: np.ndarray, keys: np.ndarray, vectors: np.ndarray, above: int = 0) -> pa.RecordBatch:
    """The rows of a batch by leaf, each of them in all of its leaves."""
    out: dict[str, list] = {"leaf": [], "dirs": [], "block": []}
    for p in np.unique(leaves):
        at = np.flatnonzero((leaves == p).any(axis=1))
        out["leaf"].append(above + int(p))
        out["dirs"].append(keys[at].tobytes())
        out["block"].append(pack(vectors[at]))
    return pa.RecordBatch.from_pydict(out, schema=BLOCKS)


def read_blocks(dirs: pd.Series, blocks: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of several blocks, each direction once."""
    keys, at = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in dirs]), return_index=True)
    return keys, np.concatenate([unpack(x, dim) for x in blocks])[at]


def grow(blocks: DataFrame, dim: int, levels: int, members: float, seed: int) -> DataFrame:
    """The blocks of ``blocks`` in leaves ``levels`` levels further down; leaves have about ``members`` now.

    Each leaf is fitted anew on a sample of its own, of ``SAMPLE_ROWS`` at most, drawn
    by the keys of its directions, and its vectors take the leaf that they fall in.
    """
    limit = int(min(1.0, SAMPLE_ROWS / members) * 2**32)

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for leaf, dirs, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys = np.frombuffer(dirs, np.int64)
                at = np.flatnonzero(keys.view(np.uint64) >> np.uint64(32) < limit)
                if len(at):
                    yield pa.RecordBatch.from_pydict({"leaf": [leaf], "dirs": [keys[at].tobytes()], "block": [pack(unpack(block, dim)[at])]}, schema=BLOCKS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["leaf"].iloc[0])
        ((cells, centres, cell_of),) = fit_forest(unit(read_blocks(pdf["dirs"], pdf["block"], dim)[1][:SAMPLE_ROWS]), 1, levels, seed + leaf)
        return pd.DataFrame({"leaf": [leaf], "cells": [cells.tobytes()], "centres": [centres.tobytes()], "cell_of": [cell_of.tobytes()]})

    def descend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for leaf, dirs, block, cells, centres, cell_of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, v = np.frombuffer(dirs, np.int64), unpack(block, dim)
                if centres is None:  # none of its members was drawn
                    yield pa.RecordBatch.from_pydict({"leaf": [leaf << levels], "dirs": [dirs], "block": [block]}, schema=BLOCKS)
                    continue
                tree = np.frombuffer(cells, np.float32).reshape(-1, dim), np.frombuffer(centres, np.float32).reshape(-1, dim), np.frombuffer(cell_of, np.int64)
                yield blocks_of(best_leaves(unit(v), [tree], 1), keys, v, leaf << levels)

    shape = "leaf long, dirs binary, block binary"
    fitted = blocks.mapInArrow(pick, shape).groupBy("leaf").applyInPandas(fit, "leaf long, cells binary, centres binary, cell_of binary")
    return blocks.join(fitted, "leaf", "left").select("leaf", "dirs", "block", "cells", "centres", "cell_of").mapInArrow(descend, shape)


def nearest_neighbors(df: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 5, least: float = -1.0, trees: int = 2, probes: int = 4, leaf_members: int = 1_500, seed: int = 7, exact: bool = False) -> DataFrame:
    """The ``k`` most similar other rows of every row.

    Result: ``id, neighbor, cosine``, at most ``k`` rows per id, only with a cosine
    of ``least`` or more. Rows whose id is null or whose vector is null, of another
    length, not finite or zero take no part; repeated rows count once; other columns
    of ``df`` are not read. Equal vectors are neighbors of their own with cosine 1;
    ties go to the smaller id among them, and between different directions to an
    arbitrary but fixed one. An empty input gives an empty result. The search is
    approximate: a true neighbor is missed when no searched leaf holds both; with
    ``exact`` all pairs of rows are compared instead, in parts of a bounded size.
    ``leaf_members``: members of a leaf on average, within a factor of 1.42; the depth of
    the trees follows from it and from the number of rows.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = src.where("id is not null").select("id").count()
    share = min(1.0, 1.3 * SAMPLE_ROWS / max(1, rows))
    picked = src.where((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)) & (F.size("v") == dim))

    def to_bytes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            _, v = eligible(b, dim)
            if len(v):
                yield pa.RecordBatch.from_pydict({"n": [len(v)], "block": [pack(unit(v))]})

    if exact:
        trees, probes, depth = 1, 1, 0
    else:
        depth = max(1, round(math.log2(max(1, rows * probes / (trees * leaf_members)))))
    blocks = picked.mapInArrow(to_bytes, "n long, block binary").collect()  # at most about SAMPLE_ROWS vectors
    sample = np.concatenate([unpack(bytes(b.block), dim) for b in blocks])[:SAMPLE_ROWS] if blocks else np.zeros((0, dim), np.float32)
    del blocks
    first_levels = min(depth, FITTED_LEVELS)
    fitted = fit_forest(sample, trees, first_levels, seed)
    forest = spark.sparkContext.broadcast(fitted)
    # The sample tells which leaves will outgrow a task; these are shared out by pairs of parts.
    crowd = np.bincount(best_leaves(sample, fitted, probes).ravel(), minlength=trees << first_levels) if len(sample) else np.zeros(1)
    crowd = crowd * (rows / max(1, len(sample)) / 2 ** (depth - first_levels))
    hot = {int(p): math.ceil(crowd[p] / HOT_LEAF) for p in np.flatnonzero(crowd > 2 * HOT_LEAF)}

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        held_keys, held, n = [], [], 0

        def flush() -> pa.RecordBatch:
            keys, v = np.concatenate(held_keys), np.concatenate(held)
            return blocks_of(best_leaves(unit(v), forest.value, probes), keys, v)

        for b in it:
            _, v = eligible(b, dim)
            keys = direction_keys(v) if len(v) else np.zeros(0, np.int64)
            _, first = np.unique(keys, return_index=True)
            first = np.array([i for i in np.sort(first) if int(keys[i]) not in sent], np.int64)
            sent.update(int(x) for x in keys[first])
            if len(sent) > 1_000_000:
                sent.clear()  # only saves repeats; leaves drop the rest
            if len(first):
                held_keys.append(keys[first])
                held.append(v[first])
                n += len(first)
            if n >= 12_000:
                yield flush()
                held_keys, held, n = [], [], 0
        if n:
            yield flush()

    def share_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of hot leaves, part by part, once for each pair of parts that the part belongs to."""
        for b in it:
            out: dict[str, list] = {"leaf": [], "a": [], "b": [], "dirs": [], "block": []}
            for leaf, dirs, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = hot.get(leaf >> (depth - first_levels), 1)
                keys = np.frombuffer(dirs, np.int64)
                part = (keys.view(np.uint64) % np.uint64(m)).astype(np.int64)
                for p in range(m):
                    at = np.flatnonzero(part == p)
                    if not len(at):
                        continue
                    mine = (dirs, block) if m == 1 else (keys[at].tobytes(), pack(unpack(block, dim)[at]))
                    for q in range(m):
                        for name, x in zip(out, (leaf, min(p, q), max(p, q), *mine), strict=True):
                            out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("leaf", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("dirs", pa.binary()), ("block", pa.binary())]))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, v = read_blocks(pdf["dirs"], pdf["block"], dim)
        leaf, a, b = (int(pdf[c].iloc[0]) for c in ("leaf", "a", "b"))
        m = hot.get(leaf >> (depth - first_levels), 1)
        part = (keys.view(np.uint64) % np.uint64(m)).astype(np.int64)
        return leaf_partners(keys, unit(v), k, least, (part, a, b))

    def name(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, v = eligible(b, dim)
            if len(ids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(direction_keys(v))], ["id", "dir"])

    members_of = src.mapInArrow(route, "leaf long, dirs binary, block binary")
    deep, members = depth - first_levels, rows * probes / (trees << first_levels)
    while deep > 0:  # levels that the first sample could not fit
        step = min(deep, FITTED_LEVELS)
        members_of = grow(members_of, dim, step, members, seed)
        deep, members = deep - step, members / 2**step
    if hot:
        members_of = members_of.mapInArrow(share_out, "leaf long, a long, b long, dirs binary, block binary")
    else:
        members_of = members_of.select("leaf", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "dirs", "block")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * probes / TASK_VECTORS))
    found = members_of.repartition(tasks, "leaf", "a", "b").groupBy("leaf", "a", "b").applyInPandas(search, "dir long, partners array<long>, cosines array<float>")
    members = src.mapInArrow(name, "id string, dir long").distinct()
    # Of each direction the k + 1 smallest ids are enough to give any row its k equal neighbors.
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy("id"))).where(F.col("r") <= k + 1)
    first = first.groupBy("dir").agg(F.sort_array(F.collect_list("id")).alias("own"))
    merged = found.groupBy("dir").agg(F.flatten(F.collect_list(F.arrays_zip(F.transform("cosines", lambda c: -c).alias("far"), F.col("partners").alias("to")))).alias("all"))
    merged = merged.select("dir", F.explode(F.slice(F.array_sort(F.array_distinct("all")), 1, k)).alias("x")).select("dir", F.col("x.far").alias("far"), F.col("x.to").alias("to"))
    others = merged.join(first.select(F.col("dir").alias("to"), F.col("own").alias("theirs")), "to")
    others = others.groupBy("dir").agg(F.array_sort(F.flatten(F.collect_list(F.transform("theirs", lambda i: F.struct(F.col("far"), i.alias("id")))))).alias("near"))
    reach = first.join(others, "dir", "left").select("dir", "own", F.slice(F.coalesce("near", F.array().cast("array<struct<far:float,id:string>>")), 1, k).alias("near"))
    near = members.join(reach, "dir").select("id", F.explode(F.slice(F.concat(F.transform(F.filter("own", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).cast("float").alias("far"), i.alias("id"))), "near"), 1, k)).alias("x"))
    return near.select("id", F.col("x.id").alias("neighbor"), (-F.col("x.far")).cast("double").alias("cosine")).where(F.col("cosine") >= F.lit(least))


def similar_pairs(df: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 5, least: float = 0.7, **search) -> DataFrame:
    """Pairs ``a < b`` with a cosine of ``least`` or more of which one is among the ``k`` nearest of the other.

    Nulls, repeated rows and ties: see ``nearest_neighbors``.
    """
    near = nearest_neighbors(df, id_col, vector_col, dim, k, least, **search)
    return near.select(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b")).distinct()
