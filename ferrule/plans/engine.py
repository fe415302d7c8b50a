"""The engine's four operations: index, query, health, evaluate."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.config import Settings
from ferrule.functions import names, vectors
from ferrule.operators import context, evaluation, graph, parsing, search
from ferrule.plans.cache import Cache
from ferrule.runtime import checkpoint
from ferrule.sources.files import directory
from ferrule.sources.store import TableStore, WriteLog, wal_key


class Embedder(Protocol):
    """Turns a text column into unit vectors; ``is_query`` sets the task."""

    dims: int

    def column(self, text: Column, is_query: bool = False) -> Column: ...


class HashEmbedder:
    """A model-free embedder: signed feature hashing of tokens, at unit length. Documents and queries share it."""

    def __init__(self, dims: int = 768) -> None:
        self.dims = dims

    def column(self, text: Column, is_query: bool = False) -> Column:
        dims = self.dims

        def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, tuple[int, float]] = {}
            for s in it:
                out = np.zeros((len(s), dims), np.float32)
                for i, t in enumerate(s):
                    for w in (t or "").lower().split():
                        if w not in known:
                            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                            known[w] = (h % dims, 1.0 if h >> 63 else -1.0)
                        at, sign = known[w]
                        out[i, at] += sign
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)
                yield pd.Series(list(out))

        def typed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return run(it)

        return F.pandas_udf(typed, "array<float>")(text)


#: A generator takes a prompt and gives a text and its tokens; this one copies the start of the context.
Generator = Callable[[str], tuple[str, int]]


def extractive(prompt: str) -> tuple[str, int]:
    text = prompt.strip().split("\n\n")[1] if "\n\n" in prompt.strip() else prompt
    return text[:400], len(prompt.split())


@dataclass
class Engine:
    """Tables, settings and models that the operations share."""

    spark: SparkSession
    store: TableStore
    log: WriteLog
    settings: Settings
    embedder: Embedder
    generate: Generator = extractive
    cache: Cache = field(default_factory=Cache)

    def index(self, files: DataFrame, force: bool = False) -> dict:
        """Parses new files, embeds and stores their chunks, and resolves the edges of their repositories.

        A file counts as known by the hash of its content, so changed files are read
        again; files without chunks are logged too. A file that does not parse is logged
        as such with its error, and tried again by the next call.
        """
        began = time.time()
        keyed = files.withColumn("kwargs", F.create_map(F.lit("hash"), F.sha2("content", 256), F.lit("path"), F.col("path"))).withColumn("key", wal_key(F.col("repo_name"), F.lit("file_indexed"), F.col("kwargs")))
        todo = keyed if force else keyed.join(self.log.done(), "key", "left_anti")
        todo = checkpoint(todo.dropDuplicates(["key"]))
        n, broken = todo.count(), 0
        if n:
            tried = checkpoint(parsing.chunk_files(todo, self.settings.window_chars, self.settings.window_stride))
            failed = tried.where("error is not null").select("repo_name", F.col("file_path").alias("path"), "error").dropDuplicates(["repo_name", "path"])
            broken = failed.count()
            parsed = tried.where("error is null").drop("error").withColumn("vector_768", self.embedder.column(F.col("text")))
            parsed = checkpoint(parsed.withColumn("vector_128", vectors.truncated("vector_768", self.settings.short_dims).cast("array<float>")))
            self.store.add_chunks(parsed)
            chunks = self.store.read("chunks")
            raw = graph.hydrate_raw_edges(chunks).join(chunks.select(F.col("chunk_id").alias("source_id"), "repo_name"), "source_id")
            self.store.add_edges(graph.resolve_edges(raw, chunks))
            self.cache.clear()
            if broken:
                self.log.record(failed.select(F.col("repo_name").alias("repo"), F.lit("parse_failed").alias("op"), F.create_map(F.lit("error"), F.col("error"), F.lit("path"), F.col("path")).alias("kwargs")))
            self.log.record(todo.join(failed, ["repo_name", "path"], "left_anti").select(F.col("repo_name").alias("repo"), F.lit("file_indexed").alias("op"), "kwargs"))
        return {"files_processed": n, "files_failed": broken, "files_skipped": files.count() - n, "total_chunks": self.store.read("chunks").count(), "elapsed_s": round(time.time() - began, 3)}

    def index_directory(self, root: str, repo: str, force: bool = False) -> dict:
        """``index`` for the source files below a folder, up to ``max_file_bytes`` each."""
        return self.index(directory(self.spark, root, repo, self.settings.max_file_bytes), force)

    def nearest(self, questions: DataFrame) -> DataFrame:
        """The chunks of all repositories nearest to each question (``query_id, question``), over the inverted-file index."""
        q = questions.select("query_id", self.embedder.column(F.col("question"), True).alias("vector_768"))
        rows = self.store.read("chunks").select(F.col("chunk_id").alias("query_id"), "vector_768")
        return search.ann_topk(q, rows, "query_id", "query_id", "vector_768", self.settings.top_k, self.settings.ann_min_rows)

    def candidates(self, questions: DataFrame) -> DataFrame:
        """Hybrid hits of questions (``query_id, question, repo_name``): short-vector cascade and BM25, fused."""
        s, chunks = self.settings, self.store.read("chunks")
        q = questions.withColumn("vector_768", self.embedder.column(F.col("question"), True))
        return hybrid(q, chunks, s.top_k, s.top_k * s.candidate_factor, s.short_dims, s.rrf_k, s.bm25_scope == "tenant")

    def query(self, questions: DataFrame) -> DataFrame:
        """Prompt and sources of every question: seeds, one hop of neighbours, one context within the budget.

        ``questions``: ``query_id, question, repo_name`` and, where wanted, ``symbol, filename, language``.
        Adds ``route, n, context, prompt`` and ``sources`` (chunk, how it was found, start of its text) in order.
        """
        s, chunks, nodes, edges = self.settings, self.store.read("chunks"), self.store.read("nodes"), self.store.read("edges")
        asked = questions.withColumn("vector_768", self.embedder.column(F.col("question"), True))
        hits = retrieve(asked, chunks, s.top_k, s.top_k * s.candidate_factor, s.short_dims, s.rrf_k, s.bm25_scope == "tenant").select("query_id", F.col("row_id").alias("chunk_id"), F.col("rank").alias("pos"), "source")
        hits = checkpoint(hits)  # a few rows per question, read three times below
        near = graph.expand_neighbors(hits.select("query_id", "chunk_id"), edges, nodes, s.neighbor_limit)
        near = near.select("query_id", "chunk_id", F.dense_rank().over(Window.partitionBy("query_id").orderBy("chunk_id")).alias("pos"), F.lit("graph_expand").alias("source"))
        placed = context.interleave(graph.merge_hits(hits, near))
        read = placed.join(chunks, "chunk_id")
        blocks = read.select("query_id", "place", context.block().alias("block"))
        ctx = context.assembled(context.within_budget(blocks, "query_id", "place", "block", s.context_chars), "query_id", "place", "block")
        sources = read.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "source", names.snippet(F.col("text")).alias("snippet")))).alias("sources"))
        routed = questions.withColumn("route", context.route(F.col("question")))
        return routed.join(ctx, "query_id", "left").join(sources, "query_id", "left").withColumn("prompt", context.prompt(F.col("route"), F.col("context"), F.col("question")))

    def answer(self, question: str, repo: str) -> dict:
        """One question to its end: the only place where the generator runs on the driver."""
        began = time.time()
        q = self.spark.createDataFrame([(0, question, repo)], "query_id long, question string, repo_name string")
        row = self.query(q).first()
        text, used = self.generate(row["prompt"])
        return {"answer": text, "route": row["route"], "chunks": row["n"] or 0, "sources": [(x["chunk_id"], x["source"], x["snippet"]) for x in row["sources"] or []], "tokens": used, "latency_ms": round(1000 * (time.time() - began), 1)}

    def cached_answer(self, question: str, repo: str) -> dict:
        """``answer``, kept until the tables change."""
        return self.cache.get("answer", (question, repo), lambda: self.answer(question, repo))

    def generated(self, prompts: DataFrame, column: str = "prompt") -> DataFrame:
        """Adds ``reply`` to a table of prompts, generated on the executors, and ``error`` where a prompt failed."""
        generate = self.generate

        def run(s: pd.Series) -> pd.DataFrame:
            out: dict[str, list] = {"reply": [], "error": []}
            for p in s:
                reply = error = None
                try:
                    reply = generate(p)[0] if isinstance(p, str) else None
                except Exception as e:  # a model that fails on one prompt fails on no other
                    error = f"{type(e).__name__}: {e}"
                out["reply"].append(reply)
                out["error"].append(error)
            return pd.DataFrame(out)

        got = prompts.withColumn("_got", F.pandas_udf(run, "reply string, error string")(column))
        return got.withColumn("reply", F.col("_got.reply")).withColumn("error", F.col("_got.error")).drop("_got")

    def judged(self, answers: DataFrame) -> DataFrame:
        """A judge's score for a fixed share (``judge_rate``) of answers (``query_id, answer, context``); null where it gives no number."""
        ask = context.filled("How far does the text support the answer? Reply with 'Score: <0 to 1>'.\n\nText: {context}\n\nAnswer: {question}", F.left("context", F.lit(2000)), F.col("answer"))
        picked = answers.where(evaluation.sampled(F.col("query_id"), self.settings.judge_rate)).withColumn("prompt", ask)
        return self.generated(picked).select("query_id", evaluation.judge_score(F.col("reply")).alias("faithfulness"))

    def relevance(self, answers: DataFrame) -> DataFrame:
        """A judge's score of how well answers fit their questions (``query_id, question, answer``); null where it gives no number."""
        ask = context.filled("How well does the text answer the question? Reply with 'Score: <0 to 1>'.\n\nText: {context}\n\nQuestion: {question}", F.left("answer", F.lit(2000)), F.col("question"))
        return self.generated(answers.withColumn("prompt", ask)).select("query_id", evaluation.judge_score(F.col("reply")).alias("relevance"))

    def golden(self, n: int) -> DataFrame:
        """Question-answer rows for the ``n`` chunks that call most, from the chunk and up to five neighbours.

        Replies that hold no question or answer are dropped; three times ``n`` anchors are tried.
        """
        chunks, edges, nodes = self.store.read("chunks"), self.store.read("edges"), self.store.read("nodes")
        top = graph.high_degree(edges, 3 * n).select(F.col("chunk_id").alias("query_id"), "chunk_id", F.col("degree"))
        near = graph.expand_neighbors(top.select("query_id", "chunk_id"), edges, nodes, 5)
        both = top.select("query_id", "chunk_id", F.lit(0).alias("p")).unionByName(near.withColumn("p", F.lit(1)))
        blocks = both.join(chunks, "chunk_id").select("query_id", F.struct("p", "chunk_id").alias("place"), context.block().alias("block"), "chunk_id")
        ctx = context.assembled(blocks, "query_id", "place", "block").join(blocks.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("expected_chunk_ids")), "query_id")
        ask = context.filled("Write one question that this code answers, and its answer, as JSON with the keys question and answer.\n\n{context}{question}", F.left("context", F.lit(4000)), F.lit(""))
        got = self.generated(ctx.withColumn("prompt", ask)).withColumn("qa", evaluation.qa_fields(F.col("reply")))
        got = got.where("qa.question is not null and qa.answer is not null").join(chunks.select(F.col("chunk_id").alias("query_id"), F.col("symbol_name").alias("_anchor_symbol"), F.col("file_path").alias("_anchor_file")), "query_id").join(top.select("query_id", "degree"), "query_id")
        out = got.orderBy(F.desc("degree"), "query_id").limit(n)
        return out.select(F.col("qa.question").alias("question"), "expected_chunk_ids", F.left("context", F.lit(2000)).alias("expected_context"), F.col("qa.answer").alias("ground_truth_answer"), "_anchor_symbol", "_anchor_file")

    def health(self) -> dict:
        stats = graph.store_stats(*(self.store.read(t) for t in ("chunks", "nodes", "edges")))
        return {"status": "ok"} | {r["what"]: r["n"] for r in stats.collect()}

    def evaluated(self, golden: DataFrame, judge: bool = True) -> DataFrame:
        """A row per golden question (``query_id, question, repo_name, expected_chunk_ids``), answered in one job.

        Result: ``query_id, question, route, chunks_retrieved, precision_at_5,
        context_recall, answer_relevance, faithfulness, latency_ms, error``. A question
        whose answer failed has its error and zeros; faithfulness is null beyond the
        judged share; latency is the job's time by question.
        """
        began, score = time.time(), F.lit(None).cast("double")
        asked = checkpoint(self.generated(self.query(golden)))
        latency = 1000 * (time.time() - began) / max(1, asked.count())
        fine = F.col("error").isNull()
        hits = F.filter("sources", lambda x: x["source"] != "graph_expand")
        rows = asked.withColumn("retrieved", F.transform(F.array_sort(F.transform(hits, lambda x: F.struct(x["place"], x["chunk_id"]))), lambda x: x["chunk_id"]))
        rows = rows.withColumn("answer_relevance", evaluation.answer_cosine(F.col("reply"), F.col("question"), self.embedder.column(F.col("reply")), self.embedder.column(F.col("question"), True)))
        if judge:
            rows = rows.join(self.judged(asked.select("query_id", F.col("reply").alias("answer"), "context")), "query_id", "left")
            score = F.col("faithfulness")
        measures = {"precision_at_5": evaluation.precision_at_k(F.col("retrieved"), F.col("expected_chunk_ids")), "context_recall": evaluation.context_recall(F.col("retrieved"), F.col("expected_chunk_ids")), "answer_relevance": F.col("answer_relevance")}
        return rows.select("query_id", "question", "route", F.coalesce(F.size("retrieved"), F.lit(0)).alias("chunks_retrieved"), *(F.when(fine, m).otherwise(0.0).alias(n) for n, m in measures.items()), F.when(fine, score).otherwise(0.0).alias("faithfulness"), F.when(fine, F.lit(latency)).otherwise(0.0).alias("latency_ms"), "error")

    def evaluate(self, golden: DataFrame, judge: bool = True) -> DataFrame:
        """The number of golden questions and their five means."""
        return evaluation.eval_summary(self.evaluated(golden, judge))


def hybrid(questions: DataFrame, chunks: DataFrame, k: int, width: int, short_dims: int = 128, rrf_k: int = 60, text_scope: bool = True) -> DataFrame:
    """Cascade and BM25 of questions (``query_id, question, repo_name, vector_768``) within their repositories, fused.

    Columns ``symbol, filename, language``, where given, narrow the vector leg: equal
    symbol and language, path that ends with the file name. Without ``text_scope`` BM25
    goes through all repositories.

    Result: ``query_id, row_id, vector_rank, text_rank, rrf_score, rank``.
    """
    c = chunks.where("vector_768 is not null").select(F.col("chunk_id").alias("row_id"), "repo_name", F.col("vector_768").alias("rv"), "symbol_name", "file_path", "language").dropDuplicates(["row_id"])
    q = search.with_filters(questions).select("query_id", "question", "repo_name", "vector_768", *search.FILTERS)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id")
    # Short vectors are met in blocks of questions; whole ones join the candidates that are left.
    asked = q.select("query_id", F.col("repo_name").alias("scope"), vectors.truncated("vector_768", short_dims).alias("v"), *search.FILTERS)
    near = search.scoped_topk(asked, c.select("row_id", F.col("repo_name").alias("scope"), vectors.truncated("rv", short_dims).alias("v"), "symbol_name", "file_path", "language"), width).select("query_id", "row_id")
    full = near.join(q.select("query_id", "vector_768"), "query_id").join(c.select("row_id", "rv"), "row_id")
    vec = full.select("query_id", "row_id", vectors.dot("vector_768", "rv").alias("score")).withColumn("rank", F.row_number().over(w) - 1)
    text = search.bm25_topk(q, chunks, "query_id", "question", "chunk_id", names.search_content("symbol_name", "docstring", "text"), width, *(("repo_name", "repo_name") if text_scope else ()))
    return search.rrf(vec, text, k, rrf_k)


def retrieve(requests: DataFrame, chunks: DataFrame, k: int, width: int, short_dims: int = 128, rrf_k: int = 60, text_scope: bool = True, most: int = 10) -> DataFrame:
    """Seeds of every request: exact matches of its symbol, else hybrid hits.

    ``requests``: as for ``hybrid``, with ``symbol, filename, language`` where wanted.
    Exact are chunks of the repository with that symbol, a path that contains the file
    name and that language; 1 to ``most`` of them answer, none or more leave the request to
    the filtered hybrid search. Result: ``query_id, row_id, source, rank``.
    """
    req = search.with_filters(requests)
    c = chunks.select(F.col("chunk_id").alias("row_id"), "repo_name", F.col("symbol_name").alias("symbol"), "file_path", F.col("language").alias("written_in"))
    exact = req.select("query_id", "repo_name", *search.FILTERS).join(c, ["repo_name", "symbol"])
    exact = exact.where((F.col("filename").isNull() | F.contains("file_path", "filename")) & (F.col("language").isNull() | (F.col("written_in") == F.col("language")))).select("query_id", "row_id").distinct()
    w = Window.partitionBy("query_id").orderBy("row_id")
    exact = exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most + 1).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    exact = checkpoint(exact.where(F.col("n") <= most).select("query_id", "row_id", F.lit("symbol_lookup").alias("source"), F.col("rank") - 1))  # at most ``most`` rows a request
    exact = exact.toDF("query_id", "row_id", "source", "rank")
    rest = requests.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    found = hybrid(rest, chunks, k, width, short_dims, rrf_k, text_scope)
    return exact.unionByName(found.select("query_id", "row_id", F.lit("hybrid").alias("source"), F.col("rank").cast("int").alias("rank")))
