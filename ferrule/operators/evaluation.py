"""Measures of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import names, vectors


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def precision_at_k(retrieved: Column, expected: Column, k: int = 5) -> Column:
    """Share of the first ``k`` that is expected; the divisor is ``k`` even if fewer came, no expectation gives 0."""
    r, e = _list(retrieved), F.array_distinct(_list(expected))
    return F.when(F.size(e) > 0, F.size(F.array_intersect(F.slice(r, 1, k), e)) / k).otherwise(F.lit(0.0))


def context_recall(retrieved: Column, expected: Column) -> Column:
    """Share of the distinct expected ids that were retrieved; no expectation gives 0."""
    r, e = F.array_distinct(_list(retrieved)), F.array_distinct(_list(expected))
    return F.when(F.size(e) > 0, F.size(F.array_intersect(r, e)) / F.size(e)).otherwise(F.lit(0.0))


def mean(value: Column) -> Column:
    """Mean of the values that are not null, to three places; 0 if there are none."""
    return F.coalesce(F.round(F.avg(value), 3), F.lit(0.0))


def answer_cosine(answer: Column, context: Column, answer_vector: Column, context_vector: Column) -> Column:
    """Dot product of the two vectors; 0 where a text is null or blank."""
    return F.when(names.blank(answer) | names.blank(context), 0.0).otherwise(vectors.dot(answer_vector, context_vector))


def judge_score(reply: Column) -> Column:
    """The number after ``Score:`` in a judge's reply, null without one."""
    return F.nullif(F.regexp_extract(reply, r"Score:[^0-9]*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def sampled(key: Column, rate: float) -> Column:
    """A fixed share of keys, the same in every run: for operators too expensive for all rows."""
    if rate >= 1:
        return key.isNotNull()
    return F.left(F.md5(key.cast("string")), F.lit(8)) < F.lit(f"{int(rate * 2**32):08x}")


def qa_fields(reply: Column) -> Column:
    """``question`` and ``answer`` from a model's JSON reply, code fences taken off; bad JSON gives nulls."""
    bare = F.regexp_replace(reply, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.from_json(bare, "question string, answer string")


def eval_summary(rows: DataFrame) -> DataFrame:
    """Means over evaluated questions, and their number."""
    cols = ("precision_at_5", "context_recall", "answer_relevance", "faithfulness", "latency_ms")
    return rows.agg(F.count("*").alias("n"), *(mean(F.col(c)).alias(c) for c in cols))
