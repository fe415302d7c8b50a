"""Declared schemas of the tables; none is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


RAW_FILES = _struct(("repo_name", S), ("path", S), ("content", S), ("language", S), ("size_bytes", L))
CHUNKS = _struct(
    ("repo_name", S), ("chunk_id", S), ("symbol_name", S), ("chunk_type", S), ("language", S), ("parent_class", S), ("file_path", S), ("start_line", L), ("end_line", L),
    ("text", S), ("docstring", S), ("calls_out_raw", T.ArrayType(S)), ("imports_raw", T.ArrayType(S)), ("vector_768", T.ArrayType(T.FloatType())), ("vector_128", T.ArrayType(T.FloatType())),
)
NODES = _struct(("chunk_id", S), ("repo_name", S), ("symbol_name", S), ("chunk_type", S), ("language", S), ("file_path", S), ("docstring", S), ("start_line", L), ("end_line", L))
RAW_EDGES = _struct(("source_id", S), ("target_name", S), ("edge_type", S))
EDGES = _struct(("source_id", S), ("target_id", S), ("edge_type", S))
WAL = _struct(("repo", S), ("op", S), ("kwargs", T.MapType(S, S)), ("ts", D))
GOLDEN = _struct(("question", S), ("expected_chunk_ids", T.ArrayType(S)), ("expected_context", S), ("ground_truth_answer", S), ("_anchor_symbol", S), ("_anchor_file", S))

# The allowed words of enumerated columns.
CHUNK_TYPES = ("function", "class", "module")
EDGE_TYPES = ("CALLS", "IMPORTS")
LANGUAGES = ("python", "javascript", "typescript", "unknown")
