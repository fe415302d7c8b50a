"""Routing of questions, and contexts and prompts for answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of each route, in the order in which ties are settled.
ROUTES = {
    "debugging": ["error", "exception", "traceback", "bug", "fix", "failing", "not working", "broken", "crash", "null", "none", "undefined", "why is", "why does", "wrong", "incorrect", "issue"],
    "setup": ["install", "setup", "configure", "run", "start", "deploy", "docker", "requirements", "dependencies", "env", "environment", "build", "init", "initialize", "local"],
    "code_search": ["function", "method", "class", "where is", "how does", "implementation", "define", "definition", "find", "locate", "which file", "what file", "show me", "return type", "parameter", "argument", "interface"],
    "conceptual": ["architecture", "design", "overview", "explain", "what is", "how does it", "structure", "pattern", "flow", "diagram", "relationship", "difference", "why", "concept"],
}
#: Our own prompt texts by route, and those of the variants.
PROMPTS = {
    "debugging": "Find the cause of the problem in this code.\n\n{context}\n\nProblem: {question}",
    "setup": "Explain the steps from this code and configuration.\n\n{context}\n\nTask: {question}",
    "code_search": "Name the code that answers the question, with its file.\n\n{context}\n\nQuestion: {question}",
    "conceptual": "Explain how these parts work together.\n\n{context}\n\nQuestion: {question}",
}
VARIANTS = {"plain": "{context}\n\n{question}", "grounded": "Use nothing but this text:\n{context}\n\nQuestion: {question}\nIf the text does not answer it, say so.", "steps": "{context}\n\nQuestion: {question}\nThink in steps, then answer."}
BLOCK_SEPARATOR = "\n\n---\n\n"


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the words the small-lettered text contains as substrings."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def route(text: Column) -> Column:
    """The route with the most keyword hits; ties as ``ROUTES`` orders them, none or null: conceptual."""
    hits = {r: F.coalesce(keyword_hits(text, ws), F.lit(0)) for r, ws in ROUTES.items()}
    top = F.greatest(*hits.values())
    out = F.when(top == 0, F.lit("conceptual"))
    for r, h in hits.items():
        out = out.when(h == top, F.lit(r))
    return out


def block(path: str = "file_path", kind: str = "chunk_type", symbol: str = "symbol_name", docstring: str = "docstring", text: str = "text") -> Column:
    """The text block of a chunk: where it stands, its purpose if it is documented, its text."""
    head = F.concat(F.lit("# File: "), F.coalesce(path, F.lit("")), F.lit(" | "), F.coalesce(kind, F.lit("")), F.lit(": "), F.coalesce(symbol, F.lit("")))
    purpose = F.when(F.length(docstring) > 0, F.concat(F.lit("\n# Purpose: "), F.left(docstring, F.lit(100)))).otherwise("")
    return F.concat(head, purpose, F.lit("\n"), F.coalesce(text, F.lit("")))


def interleave(hits: DataFrame) -> DataFrame:
    """Of more than two retrieved hits the first half, then the neighbours, then the rest.

    ``hits``: ``query_id, order, source``; source ``graph_expand`` marks neighbours.
    Adds ``place`` from 0.
    """
    q = Window.partitionBy("query_id")
    near = F.col("source") == "graph_expand"
    mine = F.row_number().over(Window.partitionBy("query_id", near).orderBy("order"))
    h = hits.withColumn("n", F.count(F.when(~near, 1)).over(q)).withColumn("i", mine)
    half = F.floor(F.col("n") / 2)
    group = F.when(F.col("n") <= 2, F.when(near, 1).otherwise(0)).when(near, 1).when(F.col("i") <= half, 0).otherwise(2)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("group", "order")) - 1
    return h.withColumn("group", group).withColumn("place", place).drop("n", "i", "group")


def within_budget(blocks: DataFrame, key: str, place: str, text: str, budget: int = 32_000) -> DataFrame:
    """The prefix of each key's blocks whose lengths add up to ``budget`` at most; separators do not count."""
    w = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget)


def assembled(blocks: DataFrame, key: str, place: str, text: str, separator: str = BLOCK_SEPARATOR) -> DataFrame:
    """Each key's blocks joined in order: ``<key>, context, n``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])
    return blocks.groupBy(key).agg(F.array_join(ordered, separator).alias("context"), F.count("*").alias("n"))


def filled(template: str, context: Column, question: Column) -> Column:
    """A prompt text with its places filled; null context or question count as empty."""
    out, rest = [], template
    for mark, col in (("{context}", context), ("{question}", question)):
        before, _, rest = rest.partition(mark)
        out += [F.lit(before), F.coalesce(col, F.lit(""))]
    return F.concat(*out, F.lit(rest))


def prompt(route_name: Column, context: Column, question: Column) -> Column:
    out = F.lit(None).cast("string")
    for r, template in PROMPTS.items():
        out = F.when(route_name == r, filled(template, context, question)).otherwise(out)
    return out
