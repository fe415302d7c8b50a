"""Routing, contexts, prompts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import vectors
from ferrule.operators import context, evaluation
from ferrule.plans import registry as R
from ferrule.plans import graph_queries as G
from ferrule.plans import search_queries as S

CATALOG = R.Catalog()
add = CATALOG.add
C, QA, DOCS = R.CHUNKS_SQL, R.QA_SQL, R.DOCS_SQL


def _hits_sql(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({col}), '{w}')::INT" for w in words) + ")"


_ROUTE = "CASE WHEN greatest(h1, h2, h3, h4) = 0 THEN 'conceptual' " + " ".join(f"WHEN h{i} = greatest(h1, h2, h3, h4) THEN '{r}'" for i, r in enumerate(context.ROUTES, 1)) + " END"
_ROUTED = f"{QA}, h AS (SELECT qa_id, question, {', '.join(f'coalesce({_hits_sql("question", ws)}, 0) AS h{i}' for i, ws in enumerate(context.ROUTES.values(), 1))} FROM q), routed AS (SELECT qa_id, question, {_ROUTE} AS route, h1 + h2 + h3 + h4 AS hits FROM h)"


@add(f"WITH {_ROUTED} SELECT qa_id, route, hits FROM routed")
def route_query(spark, d):
    hits = sum((context.keyword_hits(F.col("question"), ws) for ws in list(context.ROUTES.values())[1:]), context.keyword_hits(F.col("question"), context.ROUTES["debugging"]))
    return R.questions(spark, d).select("qa_id", context.route(F.col("question")).alias("route"), F.coalesce(hits, F.lit(0)).alias("hits"))


_PLACED = G._MERGED + """, pn AS (SELECT *, count(*) FILTER (source <> 'graph_expand') OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, source = 'graph_expand' ORDER BY "order") AS i FROM merged),
pg AS (SELECT *, CASE WHEN n <= 2 THEN CASE WHEN source = 'graph_expand' THEN 1 ELSE 0 END WHEN source = 'graph_expand' THEN 1 WHEN i <= n // 2 THEN 0 ELSE 2 END AS g FROM pn), placed AS (SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY g, "order") - 1 AS place FROM pg)"""
_BLOCKS = f"{_PLACED}, {C}, blocks AS (SELECT p.query_id, p.place, {G._BLOCK} AS block FROM placed p JOIN c USING (chunk_id)), cut AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM blocks QUALIFY used <= 2000)"


def placed_hits(spark, d):
    return context.interleave(G.merged_hits(spark, d))


def cut_blocks(spark, d, budget: int = 2000):
    b = placed_hits(spark, d).join(R.chunks(spark, d), "chunk_id").select("query_id", "place", context.block().alias("block"))
    return context.within_budget(b, "query_id", "place", "block", budget)


@add(f"WITH {_PLACED} SELECT query_id, chunk_id, source, place FROM placed")
def interleave(spark, d):
    return placed_hits(spark, d).select("query_id", "chunk_id", "source", F.col("place").cast("long").alias("place"))


@add(f"WITH {_BLOCKS} SELECT query_id, place, used FROM cut")
def context_budget(spark, d):
    return cut_blocks(spark, d).select("query_id", F.col("place").cast("long").alias("place"), F.col("used").cast("long").alias("used"))


_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@add(f"WITH {_BLOCKS} SELECT query_id, count(*) AS n, sha256(string_agg(block, {_SEP} ORDER BY place)) AS context_hash FROM cut GROUP BY query_id")
def assemble_context(spark, d):
    return context.assembled(cut_blocks(spark, d), "query_id", "place", "block").select("query_id", "n", F.sha2("context", 256).alias("context_hash"))


@add(f"WITH {DOCS}, r AS (SELECT category, doc_id, '[' || coalesce(title, 'Untitled') || ']' || chr(10) || text AS block, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS i FROM d WHERE category IS NOT NULL) SELECT category, count(*) AS n, sha256(string_agg(block, chr(10) || chr(10) ORDER BY doc_id)) AS context_hash FROM r WHERE i <= 3 GROUP BY category")
def tutorial_context(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy("doc_id")
    top = R.documents(spark, d).where("category is not null").withColumn("i", F.row_number().over(w)).where("i <= 3")
    top = top.select("category", "doc_id", F.concat(F.lit("["), F.coalesce("title", F.lit("Untitled")), F.lit("]\n"), F.col("text")).alias("block"))
    return context.assembled(top, "category", "doc_id", "block", "\n\n").select("category", "n", F.sha2("context", 256).alias("context_hash"))


def _filled_sql(template: str) -> str:
    out = "'" + template.replace("'", "''").replace("{context}", "' || coalesce(expected_context, '') || '").replace("{question}", "' || coalesce(question, '') || '") + "'"
    return out.replace("\n", "' || chr(10) || '")


_PROMPT = "CASE route " + " ".join(f"WHEN '{r}' THEN {_filled_sql(t)}" for r, t in context.PROMPTS.items()) + " END"


@add(f"WITH {_ROUTED}, x AS (SELECT r.qa_id, r.route, r.question, q.expected_context FROM routed r JOIN q USING (qa_id)) SELECT qa_id, sha256({_PROMPT}) AS prompt_hash, sha256({_filled_sql(context.VARIANTS['grounded'])}) AS grounded_hash FROM x")
def prompt_fill(spark, d):
    q = R.questions(spark, d).withColumn("route", context.route(F.col("question")))
    grounded = context.filled(context.VARIANTS["grounded"], F.col("expected_context"), F.col("question"))
    return q.select("qa_id", F.sha2(context.prompt(F.col("route"), F.col("expected_context"), F.col("question")), 256).alias("prompt_hash"), F.sha2(grounded, 256).alias("grounded_hash"))


_GOT = f"{S.HYBRID_SQL}, got AS (SELECT query_id, list(row_id ORDER BY rank) AS r FROM fk GROUP BY query_id), ev AS (SELECT q.qa_id, coalesce(r, []) AS r, coalesce(list_distinct(expected_chunk_ids), []) AS e FROM q LEFT JOIN got ON got.query_id = q.qa_id WHERE qa_id % 50 = 0)"


def retrieved(spark, d):
    got = S.hybrid_hits(spark, d).groupBy(F.col("query_id").alias("qa_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"]).alias("retrieved"))
    return R.questions(spark, d).where("qa_id % 50 = 0").join(got, "qa_id", "left")


@add(f"WITH {_GOT} SELECT qa_id, round(CASE WHEN len(e) > 0 THEN len(list_intersect(r[1:5], e)) / 5 ELSE 0.0 END, 6) AS precision_at_5 FROM ev")
def precision_at_k(spark, d):
    return retrieved(spark, d).select("qa_id", F.round(evaluation.precision_at_k(F.col("retrieved"), F.col("expected_chunk_ids")), 6).alias("precision_at_5"))


@add(f"WITH {_GOT} SELECT qa_id, round(CASE WHEN len(e) > 0 THEN len(list_intersect(list_distinct(r), e)) / len(e) ELSE 0.0 END, 6) AS recall FROM ev")
def context_recall(spark, d):
    return retrieved(spark, d).select("qa_id", F.round(evaluation.context_recall(F.col("retrieved"), F.col("expected_chunk_ids")), 6).alias("recall"))


@add(f"WITH {_GOT} SELECT count(*) AS n, coalesce(round(avg(CASE WHEN len(e) > 0 THEN len(list_intersect(r[1:5], e)) / 5 ELSE 0.0 END), 3), 0.0) AS precision_at_5, coalesce(round(avg(CASE WHEN len(e) > 0 THEN len(list_intersect(list_distinct(r), e)) / len(e) ELSE 0.0 END), 3), 0.0) AS context_recall FROM ev")
def eval_means(spark, d):
    e = retrieved(spark, d).select(evaluation.precision_at_k(F.col("retrieved"), F.col("expected_chunk_ids")).alias("p"), evaluation.context_recall(F.col("retrieved"), F.col("expected_chunk_ids")).alias("r"))
    return e.agg(F.count("*").alias("n"), evaluation.mean(F.col("p")).alias("precision_at_5"), evaluation.mean(F.col("r")).alias("context_recall"))


@add(f"WITH {C}, p AS (SELECT chunk_id, text, docstring, vector_128::DOUBLE[] AS a, vector_768[1:128]::DOUBLE[] AS b FROM c WHERE len(vector_128) = 128 AND len(vector_768) = 768) SELECT chunk_id, round(CASE WHEN regexp_replace(coalesce(docstring, ''), '\\s+', '', 'g') = '' OR regexp_replace(coalesce(left(text, 2000), ''), '\\s+', '', 'g') = '' THEN 0.0 ELSE list_dot_product(a, b) END, 6) AS score FROM p")
def cosine_validate(spark, d):
    c = R.chunks(spark, d).where((F.size("vector_128") == 128) & (F.size("vector_768") == 768))
    score = evaluation.answer_cosine(F.col("docstring"), F.left("text", F.lit(2000)), F.col("vector_128"), F.slice("vector_768", 1, 128))
    return c.select("chunk_id", F.round(score, 6).alias("score"))


@add(f"WITH {QA} SELECT qa_id, TRY_CAST(nullif(regexp_extract('Reasoning: ' || coalesce(question, '') || chr(10) || 'Score: 0.' || (qa_id % 10), 'Score:[^0-9]*([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS score FROM q")
def judge_score_parse(spark, d):
    reply = F.concat(F.lit("Reasoning: "), F.coalesce("question", F.lit("")), F.lit("\nScore: 0."), (F.col("qa_id") % 10).cast("string"))
    return R.questions(spark, d).select("qa_id", evaluation.judge_score(reply).alias("score"))


@add(f"WITH {QA}, w AS (SELECT qa_id, '```json' || chr(10) || to_json({{'question': question, 'answer': ground_truth_answer}})::VARCHAR || chr(10) || '```' AS reply FROM q), b AS (SELECT qa_id, regexp_replace(regexp_replace(reply, '^\\s*```(json)?\\s*', ''), '\\s*```\\s*$', '') AS j FROM w) SELECT qa_id, json_extract_string(j, '$.question') AS question, json_extract_string(j, '$.answer') AS answer FROM b")
def qa_json_parse(spark, d):
    packed = F.to_json(F.struct("question", F.col("ground_truth_answer").alias("answer")))
    reply = F.concat(F.lit("```json\n"), packed, F.lit("\n```"))
    return R.questions(spark, d).select("qa_id", evaluation.qa_fields(reply).alias("x")).select("qa_id", "x.question", "x.answer")


@add(f"WITH {QA} SELECT qa_id FROM q WHERE left(md5(qa_id::VARCHAR), 8) < '{int(0.1 * 2**32):08x}'")
def judge_sample(spark, d):
    return R.questions(spark, d).where(evaluation.sampled(F.col("qa_id"), 0.1)).select("qa_id")


@add(f"WITH {C} SELECT chunk_id, round(sqrt(list_dot_product(vector_768::DOUBLE[], vector_768::DOUBLE[])), 6) AS length FROM c WHERE vector_768 IS NOT NULL")
def vector_norms(spark, d):
    return R.chunks(spark, d).where("vector_768 is not null").select("chunk_id", F.round(vectors.norm("vector_768"), 6).alias("length"))
