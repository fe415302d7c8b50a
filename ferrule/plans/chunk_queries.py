"""Texts into chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.functions import names
from ferrule.operators import chunking, graph, parsing, search
from ferrule.plans import registry as R

CATALOG = R.Catalog()
add = CATALOG.add
C, FS, DOCS = R.CHUNKS_SQL, R.FILES_SQL, R.DOCS_SQL


@add(f"""WITH {FS}, w AS (SELECT repo_name, path AS file_path, content, unnest(range(0, ceil(length(content) / 2700.0)::BIGINT)) AS i FROM f WHERE length(content) > 0)
SELECT repo_name, file_path, 'chunk_' || i AS symbol_name, 1 + length(substring(content, 1, 2700 * i)) - length(replace(substring(content, 1, 2700 * i), chr(10), '')) AS start_line,
1 + length(substring(content, 1, 2700 * i)) - length(replace(substring(content, 1, 2700 * i), chr(10), '')) + length(substring(content, 2700 * i + 1, 3000)) - length(replace(substring(content, 2700 * i + 1, 3000), chr(10), '')) AS end_line,
concat_ws('::', repo_name, replace(replace(file_path, '/', '.'), chr(92), '.'), 'module.chunk_' || i, left(sha256((2700 * i)::VARCHAR), 8)) AS chunk_id, sha256(substring(content, 2700 * i + 1, 3000)) AS text_hash FROM w""")
def overlap_chunks(spark, d):
    return chunking.overlap_windows(R.files(spark, d)).select("repo_name", "file_path", "symbol_name", "start_line", "end_line", "chunk_id", F.sha2("text", 256).alias("text_hash"))


@add(f"WITH {DOCS} SELECT doc_id, i AS pos, substring(text, 100 * i + 1, 100) AS piece FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 100.0)::BIGINT)) AS i FROM d WHERE length(text) > 0)")
def fixed_chunks(spark, d):
    return R.documents(spark, d).select("doc_id", F.posexplode(chunking.fixed_chunks(F.col("text"), 100)).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


# Chunks done and the one being filled, carried from piece to piece.
_STATE = "{'done': []::VARCHAR[], 'cur': ''}"


@add(f"""WITH {DOCS}, p AS (SELECT doc_id, list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda s: {{'done': []::VARCHAR[], 'cur': s}}) AS l FROM d WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN length(x.cur) + length(a.cur) < 150 THEN {{'done': a.done, 'cur': a.cur || x.cur || '. '}} ELSE {{'done': CASE WHEN length(a.cur) = 0 THEN a.done ELSE list_append(a.done, trim(a.cur)) END, 'cur': x.cur || '. '}} END, {_STATE}) AS a FROM p),
c AS (SELECT doc_id, CASE WHEN length(a.cur) > 0 THEN list_append(a.done, trim(a.cur)) ELSE a.done END AS l FROM r)
SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS piece FROM c""")
def sentence_chunks(spark, d):
    return R.documents(spark, d).select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@add(f"""WITH {DOCS}, t AS (SELECT doc_id, text, CASE WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10) WHEN contains(text, chr(10)) THEN chr(10) WHEN contains(text, '. ') THEN '. ' WHEN contains(text, ' ') THEN ' ' END AS sep FROM d WHERE length(text) > 0),
p AS (SELECT doc_id, sep, list_transform(string_split(text, sep), lambda s: {{'done': []::VARCHAR[], 'cur': s}}) AS l FROM t WHERE length(text) > 200 AND sep IS NOT NULL),
r AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN length(a.cur) = 0 THEN {{'done': a.done, 'cur': x.cur}} WHEN length(a.cur) + length(x.cur) + length(sep) <= 200 THEN {{'done': a.done, 'cur': a.cur || sep || x.cur}} ELSE {{'done': list_append(a.done, a.cur), 'cur': x.cur}} END, {_STATE}) AS a FROM p),
w AS (SELECT doc_id, CASE WHEN length(a.cur) > 0 THEN list_append(a.done, a.cur) ELSE a.done END AS l FROM r UNION ALL SELECT doc_id, [text] FROM t WHERE length(text) <= 200
UNION ALL SELECT doc_id, list_transform(range(0, ceil(length(text) / 200.0)::BIGINT), lambda i: substring(text, 200 * i + 1, 200)) FROM t WHERE length(text) > 200 AND sep IS NULL),
u AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS piece, unnest(list_concat([''], l[1:-2])) AS prior FROM w)
SELECT doc_id, pos, CASE WHEN pos > 0 THEN right(prior, 20) || ' ' || piece ELSE piece END AS piece FROM u""")
def separator_chunks(spark, d):
    return R.documents(spark, d).select("doc_id", F.posexplode(chunking.separator_chunks(F.col("text"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@add(f"WITH {DOCS}, p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS l FROM d) SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS piece FROM p")
def paragraph_chunks(spark, d):
    return R.documents(spark, d).select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@add(f"""WITH {DOCS}, p AS (SELECT doc_id, title, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS l FROM d WHERE title IS NOT NULL),
s AS (SELECT doc_id, title, unnest(range(0, len(l))) AS pos, unnest(l) AS piece FROM p),
t AS (SELECT doc_id, pos, list_distinct(regexp_extract_all(lower(title), '[a-z0-9_]+')) AS q, list_distinct(regexp_extract_all(lower(piece), '[a-z0-9_]+')) AS r FROM s),
v AS (SELECT doc_id, pos, CASE WHEN len(q) > 0 THEN len(list_intersect(q, r)) / len(q) ELSE 0.0 END AS score FROM t)
SELECT doc_id, pos, round(score, 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) = 1""")
def best_chunk(spark, d):
    p = R.documents(spark, d).where("title is not null").select("doc_id", "title", F.posexplode(chunking.paragraphs(F.col("text"))).alias("pos", "piece"))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "pos")
    best = p.select("doc_id", F.col("pos").cast("long").alias("pos"), search.overlap_score("title", "piece").alias("score")).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("doc_id", "pos", F.round("score", 6).alias("score"))


_BUILTINS = "[" + ", ".join(f"'{b}'" for b in graph.PYTHON_BUILTINS) + "]"


@add(f"WITH {C} SELECT chunk_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(calls_out_raw, lambda x: split_part(x, '.', 1))), lambda x: NOT list_contains({_BUILTINS}, x))), ',') AS calls FROM c WHERE language = 'python'")
def call_names(spark, d):
    return R.chunks(spark, d).where("language = 'python'").select("chunk_id", F.array_join(graph.call_names("calls_out_raw"), ",").alias("calls"))


@add(f"WITH {FS}, s AS (SELECT file_id, unnest(regexp_extract_all(content, 'from\\s*[''\"]([^''\"]+)[''\"]', 1)) AS target FROM f WHERE language IN ('javascript', 'typescript')) SELECT DISTINCT file_id, target FROM s")
def js_imports(spark, d):
    f = R.files(spark, d).where("language in ('javascript', 'typescript')")
    return f.select("file_id", F.explode(F.regexp_extract_all("content", F.lit("from\\s*['\"]([^'\"]+)['\"]"), F.lit(1))).alias("target")).distinct()


@add()
def parse_chunks(spark, d):
    return parsing.chunk_files(R.files(spark, d))


@add(f"WITH {FS} SELECT language, count(*) AS n_files, sum(length(content) - length(replace(content, chr(10), ''))) AS newlines, sum(length(content))::BIGINT AS n_chars FROM f GROUP BY ALL")
def file_measures(spark, d):
    return R.files(spark, d).groupBy("language").agg(F.count("*").alias("n_files"), F.sum(names.newlines("content")).cast("long").alias("newlines"), F.sum(F.length("content")).cast("long").alias("n_chars"))
