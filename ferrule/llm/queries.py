"""Queries of the training-data operators, by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import docpairs, leakage, neighbors, packing, provenance, qa_defects, secrets, sentences, syntax
from ferrule.runtime import checkpoint, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbors.similar_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "vector_768", 768)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documentation_pairs(table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).where("origin = 'own'").select("chunk_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_defects.defective_pairs(table(spark, sf_dir, "qa_pairs"))


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.label_files(table(spark, sf_dir, "raw_files"), language="language")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files take part; configuration files, of no known language, are then no case."""
    return p5_labels(spark, sf_dir).where("label <> 'handwritten' and language is not null and language <> 'unknown'").select("file_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(table(spark, sf_dir, "raw_files")).select("file_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "raw_files")
    return syntax.invalid_rates(files, syntax.invalid_files(files))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold credentials, with only these masked."""
    files = secrets.find_credentials(table(spark, sf_dir, "raw_files"), "file_id", "content").withColumn("source_table", F.lit("raw_files"))
    chunks = secrets.find_credentials(table(spark, sf_dir, "chunks"), "chunk_id", "text").withColumn("source_table", F.lit("chunks"))
    return files.unionByName(chunks)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_redacted(spark, sf_dir).select("source_table", "record_key", F.explode("lines").alias("line_no"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = checkpoint(packing.token_counts(table(spark, sf_dir, "documents")))
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir), 2048)


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("kind = 'run'").select("doc_id", "item_id")


def p10_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [p1_found, p2_pairs, p2_found, p4_found, p5_labels, p5_found, p6_found, p6_rates, p7_redacted, p7_found, p8_containers, p8_fill, p9_leaks, p9_found, p10_units, p10_found]
    return {q.__name__: q for q in found}


P1_SQL = """
WITH v AS (SELECT DISTINCT ON (chunk_id) chunk_id, vector_768::DOUBLE[] AS x FROM chunks WHERE len(vector_768) = 768),
u AS (SELECT chunk_id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE list_dot_product(x, x) > 0),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.x, b.x) / (a.n * b.n) AS c FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
t AS (SELECT a, b, c FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM t WHERE c >= 0.7
"""


# Words as leakage.words makes them, as far as the texts need it: links, tags, accents, invisible characters, apostrophes.
_INVISIBLE = "[\u200b\u200c\u200d\u2060\ufeff\u00ad]"
_TAGS = "<!--|-->|</?[a-zA-Z][^<>]{0,200}>"
_BARE = f"regexp_replace(regexp_replace(regexp_replace(text, '\\]\\([^()\\s]*\\)', ' ', 'g'), '{_TAGS}', '', 'g'), '{_INVISIBLE}', '', 'g')"
_WORDS = f"regexp_extract_all(replace(replace(lower(strip_accents({_BARE})), '''', ''), '\u2019', ''), '[\\p{{L}}\\p{{N}}]+')"
P9_SQL = f"""
WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT ON (item_id) item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: at small sizes a single leaf holds all vectors, so the search is exact."""
    return {"p1_found": P1_SQL, "p9_found": P9_SQL}
