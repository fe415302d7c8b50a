"""Vector and text search; query sets are the rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import names, vectors
from ferrule.operators import search
from ferrule.plans import registry as R
from ferrule.plans.engine import hybrid, retrieve
from ferrule.runtime import table

CATALOG = R.Catalog()
add = CATALOG.add
C, QA, DOCS = R.CHUNKS_SQL, R.QA_SQL, R.DOCS_SQL
_V = "v AS (SELECT DISTINCT ON (vec_id) vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), a AS (SELECT * FROM v WHERE vec_id % 50 = 0)"
_COS = "list_dot_product(a.x, v.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(v.x, v.x)))"


def _rows(spark, d):
    return table(spark, d, "embeddings").dropDuplicates(["vec_id"])


def _queries(spark, d):
    return _rows(spark, d).where("vec_id % 50 = 0")


def _tidy(df, digits: int = 6):
    return df.select(F.col("query_id"), "row_id", F.round("score", digits).alias("score"), F.col("rank").cast("long").alias("rank"))


def _topk(score: str, where: str = "true", k: int = 5) -> str:
    return f"WITH {_V}, s AS (SELECT a.vec_id AS query_id, v.vec_id AS row_id, {score} AS score FROM a, v WHERE {where}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) - 1 AS rank FROM s) SELECT query_id, row_id, round(score, 6) AS score, rank FROM t WHERE rank < {k}"


@add(f"WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT vec_id, x[1:16] AS y FROM v) SELECT vec_id, pos, round(y[pos + 1] / greatest(sqrt(list_dot_product(y, y)), 1e-10), 6) AS value FROM (SELECT vec_id, y, unnest(range(0, 16)) AS pos FROM s)")
def mrl_truncate(spark, d):
    return _rows(spark, d).select("vec_id", F.posexplode(vectors.truncated("embedding", 16)).alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@add(_topk(_COS, "a.vec_id <> v.vec_id"))
def vector_topk(spark, d):
    return _tidy(search.vector_topk(_queries(spark, d), _rows(spark, d), "vec_id", "vec_id", "embedding", 5, exclude_self=True))


@add(_topk("-list_distance(a.x, v.x)", "a.vec_id <> v.vec_id"))
def l2_topk(spark, d):
    return _tidy(search.vector_topk(_queries(spark, d), _rows(spark, d), "vec_id", "vec_id", "embedding", 5, "euclidean", exclude_self=True))


@add(_topk("list_dot_product(a.x, v.x)"))
def batch_topk(spark, d):
    return _tidy(search.vector_topk(_queries(spark, d), _rows(spark, d), "vec_id", "vec_id", "embedding", 5, "dot"))


@add(f"WITH {_V} SELECT a.vec_id AS a_id, v.vec_id AS b_id, round({_COS}, 6) AS cosine, round(list_dot_product(a.x, v.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(v.x, v.x)) + 1e-8), 6) AS cosine_eps, round(list_dot_product(a.x, v.x), 6) AS dot, round(0 - list_distance(a.x, v.x), 6) AS euclidean FROM a, v")
def metric_compare(spark, d):
    m = search.score_matrix(_queries(spark, d), _rows(spark, d), "vec_id", "vec_id", "embedding")
    return m.select(F.col("query_id").alias("a_id"), F.col("row_id").alias("b_id"), *(F.round(c, 6).alias(c) for c in ("cosine", "cosine_eps", "dot", "euclidean")))


@add(f"WITH {_V} SELECT a.vec_id AS a_id, v.vec_id AS b_id, round({_COS}, 6) AS cosine FROM a, v WHERE v.vec_id % 50 <> 0 OR a.vec_id <= v.vec_id")
def pairwise_similarity(spark, d):
    """Each query row with every row; a pair of two query rows once."""
    m = search.score_matrix(_queries(spark, d), _rows(spark, d), "vec_id", "vec_id", "embedding").where("row_id % 50 <> 0 or query_id <= row_id")
    return m.select(F.col("query_id").alias("a_id"), F.col("row_id").alias("b_id"), F.round("cosine", 6).alias("cosine"))


@add(_topk(_COS, "a.vec_id <> v.vec_id AND v.label = 3"))
def filtered_vector_topk(spark, d):
    return _tidy(search.vector_topk(_queries(spark, d), _rows(spark, d).where("label = 3"), "vec_id", "vec_id", "embedding", 5, exclude_self=True))


@add(f"""WITH {_V}, s AS (SELECT a.vec_id AS query_id, v.vec_id AS row_id, list_dot_product(a.x[1:16], v.x[1:16]) / (sqrt(list_dot_product(a.x[1:16], a.x[1:16])) * sqrt(list_dot_product(v.x[1:16], v.x[1:16]))) AS short, list_dot_product(a.x, v.x) AS score FROM a, v),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(short, 9) DESC, row_id) <= 50), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) - 1 AS rank FROM c) SELECT query_id, row_id, round(score, 6) AS score, rank FROM t WHERE rank < 5""")
def mrl_cascade(spark, d):
    return _tidy(search.cascade(_queries(spark, d), _rows(spark, d), "vec_id", "vec_id", "embedding", 16, 5, 50))


def _bm25(queries: str, rows: str, k: int, scope: bool = False) -> str:
    """CTEs ``bm(query_id, row_id, score, rank)`` over ``queries(scope, query_id, text)`` and ``rows(scope, row_id, text)``."""
    return f"""bq AS ({queries}), br AS (SELECT scope, row_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM ({rows})),
bs AS (SELECT scope, count(*) FILTER (len(t) > 0) AS n, sum(len(t)) / count(*) FILTER (len(t) > 0) AS avgdl FROM br GROUP BY scope),
bt AS (SELECT DISTINCT scope, query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM bq),
bp AS (SELECT scope, row_id, dl, term, count(*) AS tf FROM (SELECT scope, row_id, len(t) AS dl, unnest(t) AS term FROM br) SEMI JOIN bt USING (scope, term) GROUP BY ALL),
bd AS (SELECT scope, term, count(*) AS df FROM bp GROUP BY ALL),
bm AS (SELECT query_id, row_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM bt JOIN bp USING (scope, term) JOIN bd USING (scope, term) JOIN bs USING (scope) GROUP BY ALL),
bk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) - 1 AS rank FROM bm QUALIFY rank < {k})"""


_QUESTIONS = "SELECT '' AS scope, qa_id AS query_id, question AS text FROM q WHERE qa_id % 50 = 0"
_TEXTS = "SELECT '' AS scope, chunk_id AS row_id, 'Symbol: ' || symbol_name || chr(10) || 'Docs: ' || coalesce(docstring, '') || chr(10) || text AS text FROM c"
_TQ = "SELECT split_part(expected_chunk_ids[1], '::', 1) AS scope, qa_id AS query_id, question AS text FROM q WHERE qa_id % 50 = 0"
_TT = _TEXTS.replace("'' AS scope", "repo_name AS scope")


@add(f"WITH {QA}, {C}, {_bm25(_QUESTIONS, _TEXTS, 10)} SELECT query_id, row_id, round(score, 6) AS score, rank FROM bk")
def bm25_topk(spark, d):
    q = R.questions(spark, d).where("qa_id % 50 = 0")
    return _tidy(search.bm25_topk(q, R.chunks(spark, d), "qa_id", "question", "chunk_id", names.search_content("symbol_name", "docstring", "text"), 10))


@add(f"WITH {QA}, {C}, {_bm25(_TQ, _TT, 10)} SELECT query_id, row_id, round(score, 6) AS score, rank FROM bk")
def bm25_tenant_topk(spark, d):
    q = R.questions(spark, d).where("qa_id % 50 = 0").withColumn("repo", F.split_part(F.get("expected_chunk_ids", F.lit(0)), F.lit("::"), F.lit(1)))
    return _tidy(search.bm25_topk(q, R.chunks(spark, d), "qa_id", "question", "chunk_id", names.search_content("symbol_name", "docstring", "text"), 10, "repo", "repo_name"))


# The question of a pair takes the place of an embedded question with the vector of its first expected chunk.
_VECS = """va AS (SELECT q.qa_id AS query_id, c.repo_name, c.vector_768::DOUBLE[] AS x FROM q JOIN c ON c.chunk_id = q.expected_chunk_ids[1] WHERE qa_id % 50 = 0 AND len(c.vector_768) = 768),
vb AS (SELECT chunk_id AS row_id, repo_name, vector_768::DOUBLE[] AS y FROM c WHERE len(vector_768) = 768),
vs AS (SELECT query_id, row_id, list_dot_product(x[1:128], y[1:128]) / (greatest(sqrt(list_dot_product(x[1:128], x[1:128])), 1e-10) * greatest(sqrt(list_dot_product(y[1:128], y[1:128])), 1e-10)) AS short, list_dot_product(x, y) AS score FROM va JOIN vb USING (repo_name)),
vc AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(short, 9) DESC, row_id) <= 50),
vk AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) - 1 AS rank FROM vc)"""
_FUSED = "fu AS (SELECT coalesce(vk.query_id, bk.query_id) AS query_id, coalesce(vk.row_id, bk.row_id) AS row_id, vk.rank AS vector_rank, bk.rank AS text_rank, coalesce(1.0::DOUBLE / (60 + vk.rank), 0) + coalesce(1.0::DOUBLE / (60 + bk.rank), 0) AS s FROM vk FULL JOIN bk ON vk.query_id = bk.query_id AND vk.row_id = bk.row_id), fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vector_rank ASC NULLS LAST, text_rank ASC NULLS LAST) - 1 AS rank FROM fu QUALIFY rank < 5)"
_AGREES = "(req.filename IS NULL OR {}(c.file_path, req.filename)) AND (req.language IS NULL OR c.language = req.language)"
_NARROWED = _VECS.replace("FROM va JOIN vb USING (repo_name)", f"FROM va JOIN vb USING (repo_name) JOIN req USING (query_id) JOIN c ON c.chunk_id = row_id WHERE (req.symbol IS NULL OR c.symbol_name = req.symbol) AND {_AGREES.format('ends_with')}")
GATED_SQL = f"""{QA}, {C}, req AS (SELECT qa_id AS query_id, split_part(expected_chunk_ids[1], '::', 1) AS repo_name, nullif(trim(_anchor_symbol), '') AS symbol, CASE WHEN qa_id % 100 = 0 THEN nullif(trim(_anchor_file), '') END AS filename, CASE WHEN qa_id % 200 = 0 THEN 'python' END AS language FROM q WHERE qa_id % 50 = 0),
ex AS (SELECT query_id, chunk_id AS row_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM req JOIN c ON c.repo_name = req.repo_name AND c.symbol_name = req.symbol AND {_AGREES.format("contains")}),
{_bm25(_TQ, _TT, 50)}, {_NARROWED}, {_FUSED}
SELECT query_id, row_id, 'symbol_lookup' AS source, rank FROM ex WHERE n <= 10 UNION ALL SELECT query_id, row_id, 'hybrid', rank FROM fk WHERE query_id NOT IN (SELECT query_id FROM ex WHERE n <= 10)"""
HYBRID_SQL = f"{QA}, {C}, {_bm25(_TQ, _TT, 50)}, {_VECS}, {_FUSED}"


def embedded_questions(spark, d, every: int = 50):
    c = R.chunks(spark, d).where(F.size("vector_768") == 768).select(F.col("chunk_id").alias("first_id"), "repo_name", "vector_768")
    q = R.questions(spark, d).where(F.col("qa_id") % every == 0).select(F.col("qa_id").alias("query_id"), "question", F.get("expected_chunk_ids", F.lit(0)).alias("first_id"))
    return q.join(c, "first_id", "left").select("query_id", "question", F.split_part("first_id", F.lit("::"), F.lit(1)).alias("repo_name"), "vector_768")


def requests(spark, d):
    """Every 50th question with the symbol of its anchor, on every other of them a file name, on every fourth a language."""
    anchors = R.questions(spark, d).select(F.col("qa_id").alias("query_id"), F.col("_anchor_symbol").alias("symbol"), F.when(F.col("qa_id") % 100 == 0, F.col("_anchor_file")).alias("filename"), F.when(F.col("qa_id") % 200 == 0, F.lit("python")).alias("language"))
    return embedded_questions(spark, d).join(anchors, "query_id")


def hybrid_hits(spark, d, every: int = 50):
    c = R.chunks(spark, d)
    sound = c.withColumn("vector_768", F.when(F.size("vector_768") == 768, F.col("vector_768")))
    return hybrid(embedded_questions(spark, d, every), sound, 5, 50)


@add(f"WITH {GATED_SQL}")
def gated_search(spark, d):
    """Requests with symbol, file name and language: exact matches where the gate lets them answer, else filtered hybrid hits."""
    c = R.chunks(spark, d)
    sound = c.withColumn("vector_768", F.when(F.size("vector_768") == 768, F.col("vector_768")))
    return retrieve(requests(spark, d), sound, 5, 50).select("query_id", "row_id", "source", F.col("rank").cast("long").alias("rank"))


@add(f"WITH {HYBRID_SQL} SELECT query_id, row_id, coalesce(vector_rank, -1) AS vector_rank, coalesce(text_rank, -1) AS text_rank, round(s, 9) AS rrf_score, rank FROM fk")
def hybrid_search(spark, d):
    return hybrid_hits(spark, d).select("query_id", "row_id", F.coalesce(F.col("vector_rank"), F.lit(-1)).cast("long").alias("vector_rank"), F.coalesce(F.col("text_rank"), F.lit(-1)).cast("long").alias("text_rank"), F.round("rrf_score", 9).alias("rrf_score"), F.col("rank").cast("long").alias("rank"))


@add(f"""WITH {_V}, s AS (SELECT a.vec_id AS query_id, v.vec_id AS row_id, {_COS} AS c, -list_distance(a.x[1:8], v.x[1:8]) AS l FROM a, v),
x AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, row_id) - 1 AS r FROM s QUALIFY r < 20), y AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY round(l, 9) DESC, row_id) - 1 AS r FROM s QUALIFY r < 20),
u AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.row_id, y.row_id) AS row_id, x.r AS a, y.r AS b, coalesce(1.0::DOUBLE / (60 + x.r), 0) + coalesce(1.0::DOUBLE / (60 + y.r), 0) AS s FROM x FULL JOIN y ON x.query_id = y.query_id AND x.row_id = y.row_id)
SELECT query_id, row_id, round(s, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, a ASC NULLS LAST, b ASC NULLS LAST) - 1 AS rank FROM u QUALIFY rank < 10""")
def rrf_fuse(spark, d):
    short = lambda df: df.select("vec_id", F.slice("embedding", 1, 8).alias("embedding"))
    a = search.vector_topk(_queries(spark, d), _rows(spark, d), "vec_id", "vec_id", "embedding", 20)
    b = search.vector_topk(short(_queries(spark, d)), short(_rows(spark, d)), "vec_id", "vec_id", "embedding", 20, "euclidean")
    return search.rrf(a, b, 10).select("query_id", "row_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("rank").cast("long").alias("rank"))


@add(f"""WITH {QA}, {C}, {_bm25(_QUESTIONS, _TEXTS, 20)}, o AS (SELECT bk.query_id, bk.row_id, list_distinct(regexp_extract_all(lower(q.question), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9_]+')) AS b FROM bk JOIN q ON q.qa_id = bk.query_id JOIN c ON c.chunk_id = bk.row_id),
s AS (SELECT query_id, row_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END AS score FROM o)
SELECT query_id, row_id, round(score, 6) AS reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) - 1 AS rank FROM s QUALIFY rank < 5""")
def rerank(spark, d):
    q = R.questions(spark, d).where("qa_id % 50 = 0")
    c = R.chunks(spark, d)
    hits = search.bm25_topk(q, c, "qa_id", "question", "chunk_id", names.search_content("symbol_name", "docstring", "text"), 20).select("query_id", "row_id")
    hits = hits.join(q.select(F.col("qa_id").alias("query_id"), "question"), "query_id").join(c.select(F.col("chunk_id").alias("row_id"), "text"), "row_id")
    out = search.rerank(hits, search.overlap_score("question", "text"), 5)
    return out.select("query_id", "row_id", F.round("reranker_score", 6).alias("reranker_score"), F.col("rank").cast("long").alias("rank"))


@add()
def ann_topk(spark, d):
    return _tidy(search.ann_topk(_queries(spark, d), _rows(spark, d), "vec_id", "vec_id", "embedding", 5))
