"""Symbol graph: resolution of names to chunks, expansion, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import names

# Callees that are built into the languages and so no edges.
PYTHON_BUILTINS = ["len", "print", "range", "isinstance", "type", "str", "int", "list", "dict", "set", "tuple", "bool", "float", "enumerate", "zip", "map", "filter", "sorted", "reversed", "open", "super", "hasattr", "getattr", "setattr", "any", "all", "max", "min"]
JAVASCRIPT_BUILTINS = ["console", "Math", "JSON", "Object", "Array", "String", "Number", "Boolean", "Date", "RegExp", "Map", "Set", "WeakMap", "WeakSet", "Promise", "Error", "Symbol", "Proxy", "Reflect", "Intl", "parseInt", "parseFloat", "isNaN", "isFinite", "decodeURI", "decodeURIComponent", "encodeURI", "encodeURIComponent", "eval", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "window", "document", "fetch", "alert", "prompt", "confirm", "navigator", "location", "localStorage", "sessionStorage", "process", "Buffer", "require", "module", "exports", "global", "super", "this", "self"]


def hydrate_raw_edges(chunks: DataFrame) -> DataFrame:
    """Unresolved edges from stored call and import lists: ``source_id, target_name, edge_type``, each once."""
    c = chunks.where("chunk_id is not null").select("chunk_id", "calls_out_raw", "imports_raw")
    part = lambda col, kind: c.select(F.col("chunk_id").alias("source_id"), F.explode(col).alias("target_name"), F.lit(kind).alias("edge_type"))
    return part("calls_out_raw", "CALLS").unionByName(part("imports_raw", "IMPORTS")).where("target_name is not null").distinct()


def decode_list(json_text: str) -> F.Column:
    """A JSON list of strings stored as text; bad JSON and null give an empty list."""
    return F.coalesce(F.from_json(F.col(json_text), "array<string>"), F.array().cast("array<string>"))


def call_names(calls: str, builtins: list[str] = PYTHON_BUILTINS) -> F.Column:
    """The distinct first segments of callees without built-ins, sorted; null counts as empty."""
    firsts = F.transform(F.coalesce(F.col(calls), F.array().cast("array<string>")), lambda x: F.split_part(x, F.lit("."), F.lit(1)))
    return F.array_sort(F.array_except(F.array_distinct(firsts), F.array(*map(F.lit, builtins))))


def resolve_edges(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """An equi-join of each raw edge's base name with the symbols of its repository.

    ``raw``: ``source_id, target_name, edge_type`` and the source's ``repo_name``.
    Result: ``source_id, target_id, edge_type``, each once, without self-loops; n
    symbols of one name give n edges; names without a symbol give none.
    """
    symbols = chunks.where("symbol_name is not null").select("repo_name", F.col("symbol_name").alias("base"), F.col("chunk_id").alias("target_id")).distinct()
    named = raw.select("repo_name", "source_id", "edge_type", names.base_name("target_name").alias("base")).distinct()
    return named.join(symbols, ["repo_name", "base"]).where("source_id <> target_id").select("source_id", "target_id", "edge_type").distinct()


def resolution_stats(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per repository the raw edges with and without a symbol of their base name; self-loops count as resolved."""
    symbols = chunks.where("symbol_name is not null").select("repo_name", F.col("symbol_name").alias("base"), F.lit(1).alias("hit")).distinct()
    named = raw.withColumn("base", names.base_name("target_name")).join(symbols, ["repo_name", "base"], "left")
    return named.groupBy("repo_name").agg(F.count("hit").alias("resolved"), F.count(F.when(F.col("hit").isNull(), 1)).alias("unresolved"))


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes, each once."""
    ids = nodes.where("chunk_id is not null").select("chunk_id").distinct()
    ends = lambda c: ids.select(F.col("chunk_id").alias(c))
    return edges.select("source_id", "target_id", "edge_type").join(ends("source_id"), "source_id", "left_semi").join(ends("target_id"), "target_id", "left_semi").select("source_id", "target_id", "edge_type").distinct()


def insert_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per edge type how many edges an insert would take and skip, repeated ones counted each time."""
    ids = nodes.where("chunk_id is not null").select("chunk_id").distinct()
    e = edges.join(ids.select(F.col("chunk_id").alias("source_id"), F.lit(1).alias("s")), "source_id", "left").join(ids.select(F.col("chunk_id").alias("target_id"), F.lit(1).alias("t")), "target_id", "left")
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    return e.groupBy("edge_type").agg(F.count(F.when(both, 1)).alias("upserted"), F.count(F.when(~both, 1)).alias("skipped"))


def expand_neighbors(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int | None = 20) -> DataFrame:
    """One hop along edges from the seeds of each query to nodes of the same repository that are no seeds.

    ``seeds``: ``query_id, chunk_id``. Result: ``query_id, chunk_id``, each once, the
    first ``limit`` by id per query.
    """
    homes = nodes.select("chunk_id", "repo_name").distinct()
    s = seeds.distinct().join(homes, "chunk_id").select("query_id", F.col("chunk_id").alias("source_id"), "repo_name")
    out = s.join(edges.select("source_id", F.col("target_id").alias("chunk_id")).distinct(), "source_id").join(homes, ["chunk_id", "repo_name"]).select("query_id", "chunk_id").distinct()
    out = out.join(seeds.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    if limit is None:
        return out
    w = Window.partitionBy("query_id").orderBy("chunk_id")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def callers(targets: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """The callers of each target (``chunk_id``), the first ``limit`` by id: ``target_id, caller_id``."""
    t = targets.select(F.col("chunk_id").alias("target_id")).where("target_id is not null").distinct()
    out = edges.where("edge_type = 'CALLS' and source_id is not null").join(t, "target_id").select("target_id", F.col("source_id").alias("caller_id")).distinct()
    w = Window.partitionBy("target_id").orderBy("caller_id")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def high_degree(edges: DataFrame, n: int, min_degree: int = 2) -> DataFrame:
    """The ``n`` sources with the most CALLS edges, at least ``min_degree``: ``chunk_id, degree``."""
    d = edges.where("edge_type = 'CALLS' and source_id is not null").groupBy(F.col("source_id").alias("chunk_id")).agg(F.count("target_id").alias("degree"))
    return d.where(F.col("degree") >= min_degree).orderBy(F.desc("degree"), "chunk_id").limit(n)


def store_stats(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of chunks, nodes and edges by type, one row each: ``what, n``."""
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    by_type = edges.groupBy(F.concat(F.lit("edges:"), F.coalesce("edge_type", F.lit("?"))).alias("what")).agg(F.count("*").alias("n"))
    return one(chunks, "chunks").unionByName(one(nodes, "nodes")).unionByName(by_type).unionByName(one(edges, "edges"))


def merge_hits(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two hit lists (``query_id, chunk_id, pos, source``) one after the other, first occurrences only.

    Result adds ``order`` from 0 over what is left.
    """
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    w = Window.partitionBy("query_id", "chunk_id").orderBy("part", "pos")
    kept = both.withColumn("r", F.row_number().over(w)).where("r = 1")
    order = Window.partitionBy("query_id").orderBy("part", "pos", "chunk_id")
    return kept.select("query_id", "chunk_id", "source", (F.row_number().over(order) - 1).alias("order"))


def symbol_gate(requests: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """Whether exact symbol matches answer a request: 1 to ``most`` of them do.

    ``requests``: ``query_id, symbol, repo_name``; a null symbol matches nothing.
    Result: ``query_id, matches, gate`` with gate ``symbol`` or ``hybrid``.
    """
    c = chunks.select("repo_name", F.col("symbol_name").alias("symbol"), "chunk_id").distinct()
    hits = requests.join(c, ["repo_name", "symbol"], "left").groupBy("query_id").agg(F.count("chunk_id").alias("matches"))
    return hits.withColumn("gate", F.when(F.col("matches").between(1, most), "symbol").otherwise("hybrid"))
