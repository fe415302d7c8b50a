"""Texts into chunks: windows, fixed widths, sentences, separators, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import names


def overlap_windows(files: DataFrame, size: int = 3000, stride: int = 2700, keep: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping windows of each file's content with line numbers and ids.

    Result: ``repo_name, file_path, symbol_name, start_char, start_line, end_line, text,
    chunk_id``, and the columns of the file named in ``keep``. Null and empty contents
    have no window; the last window may be short.
    """
    f = files.where(F.length("content") > 0).withColumn("n", F.ceil(F.length("content") / stride).cast("int"))
    # Line breaks are counted once per stride; a window's first line is the sum of the strides before it.
    breaks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: names.newlines(F.substring("content", i * stride + 1, F.lit(stride))))
    f = f.withColumn("breaks", breaks).select("repo_name", "path", "content", *keep, "breaks", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    start = F.col("i") * stride
    before = F.aggregate(F.slice("breaks", F.lit(1), F.col("i")), F.lit(0), lambda s, x: s + x)
    f = f.select("repo_name", F.col("path").alias("file_path"), F.concat(F.lit("chunk_"), F.col("i").cast("string")).alias("symbol_name"), start.alias("start_char"), F.substring("content", start + 1, F.lit(size)).alias("text"), (before + 1).alias("start_line"), *keep)
    f = f.withColumn("end_line", F.col("start_line") + names.newlines("text"))
    return f.withColumn("chunk_id", names.chunk_id("repo_name", "file_path", F.lit(None).cast("string"), "symbol_name", F.col("start_char").cast("string")))


def fixed_chunks(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters; null and empty texts give none."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentence_chunks(text: Column, target: int = 150) -> Column:
    """Greedy packing of sentences (split at ". ") while sentence and chunk stay below ``target`` together.

    A null text gives no chunk, an empty one the chunk ".".
    """
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. ")
    none = F.array().cast("array<string>")

    def add(acc: Column, s: Column) -> Column:
        joins = (F.length(s) + F.length(acc["cur"])) < target
        grown = F.concat(acc["cur"], s, F.lit(". "))
        return F.struct(F.when(joins | (F.length(acc["cur"]) == 0), acc["done"]).otherwise(F.array_append(acc["done"], F.trim(acc["cur"]))).alias("done"), F.when(joins, grown).otherwise(F.concat(s, F.lit(". "))).alias("cur"))

    start = F.struct(none.alias("done"), F.lit("").alias("cur"))
    return F.aggregate(F.coalesce(parts, none), start, add, lambda acc: F.when(F.length(acc["cur"]) > 0, F.array_append(acc["done"], F.trim(acc["cur"]))).otherwise(acc["done"]))


def separator_chunks(text: Column, size: int = 200, overlap: int = 20) -> Column:
    """Pieces between the first of blank line, line break, ". ", blank that the text has, merged while they fit.

    From the second chunk on, the last ``overlap`` characters of the chunk before and a
    blank stand in front. A text within ``size`` is one chunk; a piece beyond it stays whole;
    a longer text without any separator is cut at ``size``.
    """
    none = F.array().cast("array<string>")
    seps = ("\n\n", "\n", ". ", " ")

    def merged(sep: str) -> Column:
        pieces = F.split(text, {". ": r"\. "}.get(sep, sep))

        def add(acc: Column, p: Column) -> Column:
            fits = (F.length(acc["cur"]) + F.length(p) + len(sep)) <= size
            fresh = F.length(acc["cur"]) == 0
            return F.struct(F.when(fits | fresh, acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])).alias("done"), F.when(fresh, p).when(fits, F.concat(acc["cur"], F.lit(sep), p)).otherwise(p).alias("cur"))

        return F.aggregate(pieces, F.struct(none.alias("done"), F.lit("").alias("cur")), add, lambda acc: F.when(F.length(acc["cur"]) > 0, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]))

    out = F.when(text.isNull() | (F.length(text) == 0), none).when(F.length(text) <= size, F.array(text))
    for s in seps:
        out = out.when(F.contains(text, F.lit(s)), merged(s))
    whole = out.otherwise(fixed_chunks(text, size))
    return F.transform(whole, lambda x, i: F.when(i > 0, F.concat(F.right(F.element_at(whole, i), F.lit(overlap)), F.lit(" "), x)).otherwise(x))


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed of white space, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
