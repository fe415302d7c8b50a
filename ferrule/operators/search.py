"""Top-k search: vectors, full text, fusion.

All searches take a table of queries. Ties go to the smaller id. Where the query set
is small its rows are broadcast behind a check of their number; beyond that the rows
of both sides are met in blocks, a query block against a row block per task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ferrule.functions import names, vectors
from ferrule.runtime import checkpoint, slots

#: Queries that one broadcast may hold; more are taken in blocks of this size.
QUERY_BLOCK = 1_000
#: Questions that full-text search meets in one pass over the texts.
QUESTION_BLOCK = 10_000
#: Scores of rows by questions that a task holds at a time.
SCORES = 4_000_000


def _query_matrix(queries: DataFrame, key: str, vector: str) -> list[tuple[list, np.ndarray]]:
    """Query ids and vectors in blocks of at most ``QUERY_BLOCK``; null vectors are left out."""
    q = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["q"])
    out, ids, vecs = [], [], []
    for row in q.toLocalIterator():
        ids.append(row["q"])
        vecs.append(row["v"])
        if len(ids) == QUERY_BLOCK:
            out.append((ids, np.array(vecs, dtype=object)))
            ids, vecs = [], []
    if ids:
        out.append((ids, np.array(vecs, dtype=object)))
    return out


def vector_topk(queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, vector: str, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """The ``k`` rows nearest to each query.

    Result: ``query_id, row_id, score, rank`` (rank from 0). Each task keeps its own
    best ``k`` per query, so that only these are shuffled. Rows with null vectors or
    other lengths than the query take no part; repeated rows count once; zero vectors
    have no cosine. Ids of equal score are taken in order.
    """
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    spark, out = rows.sparkSession, None
    qt, rt = queries.schema[query_key].dataType.simpleString(), rows.schema[row_key].dataType.simpleString()
    src = rows.where(F.col(row_key).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_key).alias("row_id"), F.col(vector).cast("array<double>").alias("v"))
    for ids, vecs in _query_matrix(queries, query_key, vector) or [([], np.zeros((0, 1)))]:
        held = spark.sparkContext.broadcast((ids, vecs))

        def local(it: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, vecs = held.value
            best: dict = {i: [] for i in range(len(ids))}
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by_size.setdefault(len(v), []).append(i)
            blocks = {n: np.array([np.asarray(vecs[i], float) for i in at]) for n, at in by_size.items()}
            for pdf in it:
                for n, group in pdf.groupby(pdf["v"].map(len)):
                    if n not in blocks:
                        continue
                    m, keys = np.stack(group["v"].to_numpy()).astype(float), group["row_id"].to_numpy()
                    q = blocks[n]
                    sims = q @ m.T
                    if metric == "cosine":
                        with np.errstate(divide="ignore", invalid="ignore"):
                            sims = sims / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :])
                    elif metric == "euclidean":
                        sims = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * sims, 0))
                    for r, i in enumerate(by_size[n]):
                        ok = np.isfinite(sims[r])
                        if exclude_self:
                            ok &= keys != ids[i]
                        at = np.flatnonzero(ok)
                        if len(at) > 4 * k + 16:  # everything that ties with the kth stays
                            cut = np.partition(sims[r][at], len(at) - k)[len(at) - k]
                            at = at[sims[r][at] >= cut - 1e-9]
                        best[i] = sorted({(-round(float(s), 12), x) for s, x in zip(sims[r][at], keys[at], strict=True)} | set(best[i]))[:k]
            yield pd.DataFrame([(ids[i], x, -s) for i, b in best.items() for s, x in b], columns=["query_id", "row_id", "score"])

        part = src.mapInPandas(local, f"query_id {qt}, row_id {rt}, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id")
    return out.distinct().withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


#: What may narrow a query, beside its scope: the query's column and the row's, and how the two must agree.
FILTERS = {"symbol": ("symbol_name", lambda want, have: have == want), "filename": ("file_path", lambda want, have: isinstance(have, str) and have.endswith(want)), "language": ("language", lambda want, have: have == want)}


def with_filters(queries: DataFrame) -> DataFrame:
    """``queries`` with all columns of ``FILTERS``; a missing or blank one narrows nothing."""
    return queries.withColumns({c: F.when(~names.blank(F.col(c)), F.col(c).cast("string")) if c in queries.columns else F.lit(None).cast("string") for c in FILTERS})


def scoped_topk(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of each query's scope with the greatest dot product.

    ``queries``: ``query_id, scope, v`` and any of ``FILTERS``; ``rows``: ``row_id, scope,
    v, symbol_name, file_path, language``. Result: ``query_id, row_id, score``, ties by
    id. The stated queries are met block by block: tasks hold a block of them, go
    through their rows once and send on their best ``k`` of each query. Null vectors,
    scopes and lengths that differ give no row; repeated rows count once.
    """
    spark, out = rows.sparkSession, None
    qt, rt = queries.schema["query_id"].dataType.simpleString(), rows.schema["row_id"].dataType.simpleString()
    q = with_filters(queries).where(F.col("v").isNotNull() & F.col("scope").isNotNull() & F.col("query_id").isNotNull()).select("query_id", "scope", F.col("v").cast("array<double>").alias("v"), *FILTERS).dropDuplicates(["query_id"])
    src = rows.where(F.col("v").isNotNull() & F.col("row_id").isNotNull()).select("row_id", "scope", F.col("v").cast("array<double>").alias("v"), *(have for have, _ in FILTERS.values()))
    block: list = []

    def local(held) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked: dict = {}
            for r in held.value:
                asked.setdefault((r["scope"], len(r["v"])), []).append(r)
            best: dict = {}
            for pdf in it:
                for (scope, size), group in pdf.groupby([pdf["scope"], pdf["v"].map(len)]):
                    mine = asked.get((scope, size))
                    if not mine:
                        continue
                    keys = group["row_id"].to_numpy()
                    sims = np.array([r["v"] for r in mine]) @ np.stack(group["v"].to_numpy()).astype(float).T
                    for r, s in zip(mine, sims, strict=True):
                        ok = np.isfinite(s)
                        for want, (have, agrees) in FILTERS.items():
                            if r[want] is not None:
                                ok &= np.array([agrees(r[want], x) for x in group[have]], bool)
                        at = np.flatnonzero(ok)
                        if len(at) > 4 * k + 16:  # everything that ties with the kth stays
                            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k] - 1e-9]
                        best[r["query_id"]] = sorted({(-round(float(s[i]), 9), keys[i]) for i in at} | set(best.get(r["query_id"], ())))[:k]
            yield pd.DataFrame([(q, x, -s) for q, found in best.items() for s, x in found], columns=["query_id", "row_id", "score"])

        return run

    def search_block(out: DataFrame | None) -> DataFrame:
        part = src.mapInPandas(local(spark.sparkContext.broadcast(list(block))), f"query_id {qt}, row_id {rt}, score double")
        return part if out is None else out.unionByName(part)

    for r in q.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out = search_block(out)
            block.clear()
    if block or out is None:
        out = search_block(out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return out.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def score_matrix(queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, vector: str, epsilon: float = 1e-8) -> DataFrame:
    """Every measure of each query of a stated set with each row, query block by query block.

    Result: ``query_id, row_id, cosine, cosine_eps, dot, euclidean`` (a negative distance).
    Null vectors and pairs of different lengths give no row; a zero vector has no cosine.
    """
    spark, out = rows.sparkSession, None
    qt, rt = queries.schema[query_key].dataType.simpleString(), rows.schema[row_key].dataType.simpleString()
    src = rows.where(F.col(row_key).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_key).alias("row_id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["row_id"])
    for ids, vecs in _query_matrix(queries, query_key, vector) or [([], np.zeros((0, 1)))]:
        held = spark.sparkContext.broadcast((ids, vecs))

        def measure(it: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, vecs = held.value
            for pdf in it:
                m = pdf["v"].map(np.asarray)
                for q, v in zip(ids, vecs, strict=True):
                    v = np.asarray(v, float)
                    fit = m[m.map(len) == len(v)]
                    if not len(fit):
                        continue
                    x = np.stack(fit.to_numpy()).astype(float)
                    dots, below = x @ v, np.linalg.norm(x, axis=1) * np.linalg.norm(v)
                    cos = np.divide(dots, below, out=np.full(len(x), np.nan), where=below > 0)
                    frame = pd.DataFrame({"row_id": pdf["row_id"][fit.index], "cosine": pd.Series(cos, dtype=object, index=fit.index).where(~np.isnan(cos), None), "cosine_eps": dots / (below + epsilon), "dot": dots, "euclidean": 0.0 - np.linalg.norm(x - v, axis=1)})
                    frame.insert(0, "query_id", q)
                    yield frame

        part = src.mapInPandas(measure, f"query_id {qt}, row_id {rt}, cosine double, cosine_eps double, dot double, euclidean double")
        out = part if out is None else out.unionByName(part)
    return out


def cascade(queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, vector: str, dims: int, k: int, candidates: int) -> DataFrame:
    """Candidates by the first ``dims`` values brought to unit length, rescored by the dot product of whole vectors."""
    short = lambda df, key: df.where(F.col(vector).isNotNull()).select(key, vectors.truncated(vector, dims).alias(vector))
    first = vector_topk(short(queries, query_key), short(rows, row_key), query_key, row_key, vector, candidates)
    q = queries.select(F.col(query_key).alias("query_id"), F.col(vector).alias("qv")).dropDuplicates(["query_id"])
    r = rows.select(F.col(row_key).alias("row_id"), F.col(vector).alias("rv")).dropDuplicates(["row_id"])
    scored = first.select("query_id", "row_id").join(q, "query_id").join(r, "row_id").select("query_id", "row_id", vectors.dot("qv", "rv").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def postings(rows: DataFrame, key: str, text: Column | str, scope: str | None = None) -> DataFrame:
    """The inverted index: ``scope, term, row_id, tf, length``; null and empty texts have no postings."""
    src = rows.where(F.col(key).isNotNull()).select((F.col(scope) if scope else F.lit("")).alias("scope"), F.col(key).alias("row_id"), names.tokens(text).alias("t")).dropDuplicates(["scope", "row_id"])
    src = src.where(F.size("t") > 0).select("scope", "row_id", F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
    return src.groupBy("scope", "term", "row_id", "length").agg(F.count("*").alias("tf"))


def _best_texts(rows: DataFrame, asked: list, query_type: DataType, k: int, k1: float, b: float) -> DataFrame:
    """The ``k`` best rows by BM25 that each task finds for the queries ``asked``; see ``bm25_topk``.

    ``rows``: ``scope, row_id, text``, the text in lower case. ``asked``: rows of ``query_id`` and ``terms``, each
    with its scope. Tokens are counted where the texts are read; only ids, lengths and counts of asked terms travel.
    """
    spark, st, rt = rows.sparkSession, *(rows.schema[c].dataType.simpleString() for c in ("scope", "row_id"))
    numbers: dict = {}  # by scope and term, over all scopes
    askers: list[list[int]] = []  # by number of the term
    for i, r in enumerate(asked):
        for x in r["terms"]:
            at = numbers.setdefault(x["scope"], {}).setdefault(x["term"], len(askers))
            if at == len(askers):
                askers.append([])
            askers[at].append(i)
    wanted = spark.sparkContext.broadcast(numbers)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile("[a-z0-9_]+").findall
        for batch in it:
            at, lengths, terms, counts = [], [], [], []
            for i, (scope, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                mine = wanted.value.get(scope)
                tokens = find(text) if text and mine else ()
                if tokens:
                    tf = Counter(map(mine.get, tokens))
                    tf.pop(None, None)
                    at.append(i)
                    lengths.append(len(tokens))
                    terms.append(sorted(tf))
                    counts.append([tf[t] for t in terms[-1]])
            held = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["scope", "row_id", "dl", "terms", "tfs"])

    # Of rows with one id and different texts one takes part, the same in all that follows.
    counted = rows.mapInArrow(count, f"scope {st}, row_id {rt}, dl long, terms array<int>, tfs array<int>").groupBy("scope", "row_id").agg(F.max(F.struct("dl", "terms", "tfs")).alias("x"))
    counted = checkpoint(counted.select("scope", "row_id", "x.*"))
    stats = {r["scope"]: (r["n"], r["avgdl"]) for r in counted.groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).collect()}
    df, n, avgdl = np.ones(len(askers)), np.ones(len(askers)), np.ones(len(askers))
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    for scope, mine in numbers.items():
        n[list(mine.values())], avgdl[list(mine.values())] = stats.get(scope, (1, 1.0))
    weights = spark.sparkContext.broadcast(([r["query_id"] for r in asked], [np.array(x) for x in askers], np.log(1 + (n - df + 0.5) / (df + 0.5)), avgdl))
    found = counted.select("row_id", F.transform("terms", lambda _: F.col("dl")).alias("dls"), "terms", "tfs")
    if any(len({x["scope"] for x in r["terms"]}) > 1 for r in asked):  # a query sums up what an id has in all of its scopes
        found = found.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("terms", "tfs", "dls"))).alias("x"))
        found = found.select("row_id", *(F.flatten(F.col("x")[c]).alias(c) for c in ("dls", "terms", "tfs")))

    step = max(1, SCORES // max(1, len(asked)))
    kinds = [to_arrow_type(x) for x in (query_type, rows.schema["row_id"].dataType)] + [pa.float64()]

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, askers, idf, avgdl = weights.value
        kept: list[list] = [[] for _ in ids]  # per query: less the rounded score, row, score
        last = np.full(len(ids), -np.inf)
        for whole in it:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                keys = np.array([*batch.column(0).to_pylist(), None], object)[:-1]
                dl, terms, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                row = np.repeat(np.arange(len(keys)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
                gain = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl[terms]))
                scores = np.zeros((len(keys), len(ids)))
                order = np.argsort(terms, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(terms[order])) + 1) if len(order) else ():
                    scores[row[mine][:, None], askers[terms[mine[0]]]] += gain[mine][:, None]
                r, q = np.nonzero(scores > np.maximum(last + 4e-10, 0))  # a later row that ties with the kth has a greater id
                score = scores[r, q]
                rounded = np.round(score, 9)
                order = np.lexsort((r, -rounded, q))
                r, q, score, rounded = r[order], q[order], score[order], rounded[order]
                hit, first = np.unique(q, return_index=True)
                for at, i, j in zip(hit, first, np.append(first, len(q))[1:], strict=True):
                    j = min(j, i + k)
                    kept[at] = sorted([*kept[at], *zip(-rounded[i:j], keys[r[i:j]], score[i:j], strict=True)])[:k]
                    if len(kept[at]) == k:
                        last[at] = -kept[at][-1][0]
        rows_of = [(ids[i], x, s) for i, mine in enumerate(kept) for _, x, s in mine]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows_of], kind) for c, kind in enumerate(kinds)], ["query_id", "row_id", "score"])

    return found.coalesce(slots(spark)).sortWithinPartitions("row_id").mapInArrow(best, f"query_id {query_type.simpleString()}, row_id {rt}, score double")


def bm25_topk(queries: DataFrame, rows: DataFrame, query_key: str, query_text: str, row_key: str, row_text: Column | str, k: int, query_scope: str | None = None, row_scope: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` rows that rank highest by BM25 for each query, within the query's scope if scopes are given.

    Result: ``query_id, row_id, score, rank``. Lengths and their mean come from all rows
    of the scope, document frequencies only of terms that some query has. The queries are
    met ``QUESTION_BLOCK`` at a time; each task keeps its own best ``k`` per query, so that
    neither texts nor pairs of a query and a row are shuffled.
    """
    src = rows.where(F.col(row_key).isNotNull()).select((F.col(row_scope) if row_scope else F.lit("")).alias("scope"), F.col(row_key).alias("row_id"), F.lower(row_text).alias("text"))
    q = queries.where(F.col(query_key).isNotNull()).select((F.col(query_scope) if query_scope else F.lit("")).alias("scope"), F.col(query_key).alias("query_id"), F.explode(F.array_distinct(names.tokens(query_text))).alias("term"))
    q = q.where("scope is not null").groupBy("query_id").agg(F.collect_set(F.struct("scope", "term")).alias("terms"))
    query_type, block, out = queries.schema[query_key].dataType, [], None
    for r in q.toLocalIterator():
        block.append(r)
        if len(block) == QUESTION_BLOCK:
            part = _best_texts(src, block, query_type, k, k1, b)
            out, block = part if out is None else out.unionByName(part), []
    if block or out is None:
        part = _best_texts(src, block, query_type, k, k1, b)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id")
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def rrf(first: DataFrame, second: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (ranks from 0), ties in the order of the first, then the second list.

    Result: ``query_id, row_id, rrf_score, vector_rank, text_rank, rank``.
    """
    a = first.select("query_id", "row_id", F.col("rank").alias("vector_rank"))
    b = second.select("query_id", "row_id", F.col("rank").alias("text_rank"))
    both = a.join(b, ["query_id", "row_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", part("vector_rank") + part("text_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank"))
    return both.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def rerank(hits: DataFrame, scorer: Column, k: int | None = None) -> DataFrame:
    """Hits (``query_id, row_id, ...``) ordered anew by a scorer column, greatest first, at most ``k`` per query."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("reranker_score", 9)), "row_id")
    out = hits.withColumn("reranker_score", scorer).withColumn("rank", F.row_number().over(w) - 1)
    return out if k is None else out.where(F.col("rank") < k)


def overlap_score(query_text: Column | str, row_text: Column | str) -> Column:
    """A scorer without a model: the share of the query's tokens that the row has."""
    q, r = F.array_distinct(names.tokens(query_text)), F.array_distinct(names.tokens(row_text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, r)) / F.size(q)).otherwise(0.0)


def cells(rows: DataFrame, key: str, vector: str, n_cells: int, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """An inverted-file index: k-means cells fitted on at most 50,000 rows, and every row with its cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    src = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("row_id"), vectors.normalized(vector).alias("v")).dropDuplicates(["row_id"]).withColumn("features", array_to_vector("v"))
    fit_on = src.orderBy(F.xxhash64("row_id")).limit(50_000)
    model = KMeans(k=n_cells, seed=seed, maxIter=10, predictionCol="cell").fit(fit_on)
    centers = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, center array<double>")
    return centers, model.transform(src).select("row_id", "v", "cell")


def ann_topk(queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, vector: str, k: int, min_rows: int = 256, n_cells: int = 16, probes: int = 8) -> DataFrame:
    """Cosine top-k over an inverted-file index; a plain search up to ``min_rows`` rows.

    The ``probes`` nearest cells are read first. Each further cell is read where its
    centre and radius leave room for a row that reaches the query's ``k``-th score so
    far, so that no neighbour is lost to the cells.
    """
    if rows.limit(min_rows + 1).count() <= min_rows:
        return vector_topk(queries, rows, query_key, row_key, vector, k)
    centers, index = cells(rows, row_key, vector, n_cells)
    index = checkpoint(index)
    radii = index.join(F.broadcast(centers), "cell").groupBy("cell").agg(F.max(vectors.euclidean("v", "center")).alias("radius"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("query_id"), vectors.normalized(vector).alias("qv")).dropDuplicates(["query_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "cell")
    order = q.join(F.broadcast(centers.join(radii, "cell")), F.lit(True)).withColumn("near", vectors.dot("qv", "center")).withColumn("r", F.row_number().over(w)).drop("center")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id")

    def read(probed: DataFrame) -> DataFrame:
        scored = probed.select("query_id", "qv", "cell").join(index, "cell").select("query_id", "row_id", vectors.dot("qv", "v").alias("score"))
        return scored.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)

    first = checkpoint(read(order.where(F.col("r") <= probes)))
    reached = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    # By Cauchy-Schwarz no row of a cell scores above near + radius; 1e-8 covers rounding and ties.
    more = order.where(F.col("r") > probes).join(reached, "query_id", "left").where(F.col("kth").isNull() | (F.col("near") + F.col("radius") >= F.col("kth") - 1e-8))
    both = first.drop("rank").unionByName(read(more).drop("rank"))
    return both.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)
