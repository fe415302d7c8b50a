"""Column functions on vectors: JVM-side higher-order functions, in double precision.

Vectors of different lengths or with a null give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column | str, b: Column | str, epsilon: float = 0.0) -> Column:
    """Cosine; ``epsilon`` is added to the denominator. Without it a zero vector gives null."""
    below = norm(a) * norm(b) + F.lit(epsilon)
    return F.when(below > 0, dot(a, b) / below)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized(a: Column | str, floor: float = 1e-10) -> Column:
    """The vector at unit length; its norm counts as ``floor`` at least."""
    a = _c(a)
    # The norm is bound once, as the one element of an array: within a lambda it would be worked out for every value.
    bound = F.array(F.greatest(norm(a), F.lit(floor)))
    return F.when(a.isNotNull(), F.element_at(F.transform(bound, lambda n: F.transform(a, lambda x: x.cast("double") / n)), 1))


def truncated(a: Column | str, dims: int) -> Column:
    """The first ``dims`` values, brought back to unit length."""
    return normalized(F.slice(_c(a), 1, dims))


def similarity(a: Column | str, b: Column | str, metric: str) -> Column:
    """Score by ``cosine``, ``dot`` or ``euclidean`` (negative distance); greater is nearer."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return F.lit(0.0) - euclidean(a, b)
    raise ValueError(f"unknown metric {metric!r}")
