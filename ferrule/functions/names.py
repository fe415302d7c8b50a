"""Column functions on identifiers, projections and text measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chunk_id(repo: Column | str, path: Column | str, owner: Column | str, symbol: Column | str, signature: Column | str) -> Column:
    """``repo::path.with.dots::Class.symbol::hash``; a null or empty class is ``module``, a null signature counts as empty."""
    dotted = F.translate(_c(path), "/\\", "..")
    scoped = F.concat(F.coalesce(F.nullif(_c(owner), F.lit("")), F.lit("module")), F.lit("."), _c(symbol))
    return F.concat_ws("::", _c(repo), dotted, scoped, F.left(F.sha2(F.coalesce(_c(signature), F.lit("")), 256), F.lit(8)))


def base_name(raw: Column | str) -> Column:
    """What a call refers to: the text after ``self.`` or ``this.`` up to the end, else the first dotted segment."""
    raw = _c(raw)
    own = raw.startswith("self.") | raw.startswith("this.")
    return F.when(own, F.substr(raw, F.lit(6))).otherwise(F.split_part(raw, F.lit("."), F.lit(1)))


def search_content(symbol: Column | str, docstring: Column | str, text: Column | str) -> Column:
    """The composite text that full-text search reads."""
    return F.concat(F.lit("Symbol: "), _c(symbol), F.lit("\nDocs: "), F.coalesce(_c(docstring), F.lit("")), F.lit("\n"), _c(text))


def snippet(text: Column | str, size: int = 200) -> Column:
    text = _c(text)
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def newlines(text: Column | str) -> Column:
    text = _c(text)
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9_]+"), F.lit(0))


def blank(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", "") == ""


def conjunction(*parts: Column | None) -> Column:
    """All given conditions; None stands for a condition that was not asked for."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))
