"""The symbol graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.functions import names
from ferrule.operators import context, graph
from ferrule.plans import registry as R
from ferrule.runtime import table

CATALOG = R.Catalog()
add = CATALOG.add
C, N, E, QA = R.CHUNKS_SQL, R.NODES_SQL, R.EDGES_SQL, R.QA_SQL
_BASE = "CASE WHEN starts_with(target_name, 'self.') OR starts_with(target_name, 'this.') THEN substring(target_name, 6) ELSE split_part(target_name, '.', 1) END"
_RAW = f"{C}, raw AS (SELECT DISTINCT chunk_id AS source_id, unnest(calls_out_raw) AS target_name, 'CALLS' AS edge_type, repo_name FROM c UNION SELECT DISTINCT chunk_id, unnest(imports_raw), 'IMPORTS', repo_name FROM c)"
_RESOLVED = f"{_RAW}, sym AS (SELECT DISTINCT repo_name, symbol_name AS base, chunk_id AS target_id FROM c WHERE symbol_name IS NOT NULL), res AS (SELECT DISTINCT r.source_id, s.target_id, r.edge_type FROM (SELECT *, {_BASE} AS base FROM raw) r JOIN sym s USING (repo_name, base) WHERE r.source_id <> s.target_id)"
_SEEDS = f"{QA}, seeds AS (SELECT DISTINCT qa_id AS query_id, unnest(expected_chunk_ids) AS chunk_id FROM q)"
_HOP = f"""{N}, {E}, hop AS (SELECT DISTINCT s.query_id, e.target_id AS chunk_id FROM seeds s JOIN n a ON a.chunk_id = s.chunk_id JOIN e ON e.source_id = s.chunk_id JOIN n b ON b.chunk_id = e.target_id AND b.repo_name = a.repo_name
  WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = s.query_id AND t.chunk_id = e.target_id))"""


def _raw(spark, d):
    return graph.hydrate_raw_edges(R.chunks(spark, d)).join(R.chunks(spark, d).select(F.col("chunk_id").alias("source_id"), "repo_name"), "source_id")


def _seeds(spark, d):
    return R.questions(spark, d).select(F.col("qa_id").alias("query_id"), F.explode("expected_chunk_ids").alias("chunk_id")).distinct()


@add(f"WITH {_RAW} SELECT DISTINCT target_name, {_BASE} AS base FROM raw")
def base_name(spark, d):
    return _raw(spark, d).select("target_name", names.base_name("target_name").alias("base")).distinct()


@add(f"WITH {_RAW} SELECT source_id, target_name, edge_type FROM raw")
def hydrate_raw_edges(spark, d):
    return graph.hydrate_raw_edges(R.chunks(spark, d))


@add(f"WITH {C}, j AS (SELECT chunk_id, to_json(calls_out_raw)::VARCHAR AS calls FROM c) SELECT chunk_id, unnest(from_json(calls, '[\"VARCHAR\"]')) AS callee FROM j")
def decode_lists(spark, d):
    c = R.chunks(spark, d).select("chunk_id", F.to_json("calls_out_raw").alias("calls"))
    return c.select("chunk_id", F.explode(graph.decode_list("calls")).alias("callee"))


@add(f"WITH {_RESOLVED} SELECT * FROM res")
def resolve_edges(spark, d):
    return graph.resolve_edges(_raw(spark, d), R.chunks(spark, d))


@add(f"WITH {_RAW}, sym AS (SELECT DISTINCT repo_name, symbol_name AS base FROM c WHERE symbol_name IS NOT NULL) SELECT r.repo_name, count(s.base) AS resolved, count(*) FILTER (s.base IS NULL) AS unresolved FROM (SELECT *, {_BASE} AS base FROM raw) r LEFT JOIN sym s USING (repo_name, base) GROUP BY ALL")
def edge_resolution_stats(spark, d):
    return graph.resolution_stats(_raw(spark, d), R.chunks(spark, d))


@add(f"WITH {_SEEDS}, {_HOP} SELECT query_id, chunk_id FROM hop QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 20")
def expand_neighbors(spark, d):
    return graph.expand_neighbors(_seeds(spark, d), R.edges(spark, d), R.live_nodes(spark, d))


@add(f"WITH {_SEEDS}, {E}, t AS (SELECT DISTINCT chunk_id AS target_id FROM seeds), o AS (SELECT DISTINCT e.target_id, e.source_id AS caller_id FROM e JOIN t USING (target_id) WHERE edge_type = 'CALLS' AND source_id IS NOT NULL) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY caller_id) <= 20")
def callers(spark, d):
    return graph.callers(_seeds(spark, d).select("chunk_id"), R.edges(spark, d))


_POS = "first AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS pos FROM seeds), near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS pos FROM hop)"
_MERGED = f"{_SEEDS}, {_HOP}, {_POS}, u AS (SELECT query_id, chunk_id, pos, 'hybrid' AS source, 0 AS part FROM first UNION ALL SELECT query_id, chunk_id, pos, 'graph_expand', 1 FROM near), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part, pos) = 1), merged AS (SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY part, pos, chunk_id) - 1 AS \"order\" FROM k)"


def merged_hits(spark, d):
    w = Window.partitionBy("query_id").orderBy("chunk_id")
    ranked = lambda df, source: df.select("query_id", "chunk_id", (F.row_number().over(w) - 1).alias("pos"), F.lit(source).alias("source"))
    near = graph.expand_neighbors(_seeds(spark, d), R.edges(spark, d), R.live_nodes(spark, d), None)
    return graph.merge_hits(ranked(_seeds(spark, d), "hybrid"), ranked(near, "graph_expand"))


@add(f"WITH {_MERGED} SELECT query_id, chunk_id, source, \"order\" FROM merged")
def merge_dedup(spark, d):
    return merged_hits(spark, d)


@add(f"WITH {C}, {QA}, h AS (SELECT q.qa_id AS query_id, count(c.chunk_id) AS matches FROM q LEFT JOIN c ON c.symbol_name = q._anchor_symbol AND c.repo_name = split_part(q.expected_chunk_ids[1], '::', 1) GROUP BY ALL) SELECT query_id, matches, CASE WHEN matches BETWEEN 1 AND 10 THEN 'symbol' ELSE 'hybrid' END AS gate FROM h")
def symbol_gate(spark, d):
    q = R.questions(spark, d).select(F.col("qa_id").alias("query_id"), F.col("_anchor_symbol").alias("symbol"), F.split_part(F.get("expected_chunk_ids", F.lit(0)), F.lit("::"), F.lit(1)).alias("repo_name"))
    return graph.symbol_gate(q, R.chunks(spark, d))


_BLOCK = "'# File: ' || coalesce(file_path, '') || ' | ' || coalesce(chunk_type, '') || ': ' || coalesce(symbol_name, '') || CASE WHEN length(docstring) > 0 THEN chr(10) || '# Purpose: ' || left(docstring, 100) ELSE '' END || chr(10) || coalesce(text, '')"


@add(f"""WITH {C}, {N}, {E}, deg AS (SELECT source_id AS chunk_id, count(target_id) AS degree FROM e WHERE edge_type = 'CALLS' AND source_id IS NOT NULL GROUP BY ALL HAVING count(target_id) >= 2), top AS (SELECT * FROM deg ORDER BY degree DESC, chunk_id LIMIT 60),
hop AS (SELECT DISTINCT t.chunk_id AS anchor, e.target_id AS chunk_id FROM top t JOIN n a ON a.chunk_id = t.chunk_id JOIN e ON e.source_id = t.chunk_id JOIN n b ON b.chunk_id = e.target_id AND b.repo_name = a.repo_name WHERE e.target_id <> t.chunk_id QUALIFY dense_rank() OVER (PARTITION BY anchor ORDER BY e.target_id) <= 5),
u AS (SELECT chunk_id AS anchor, 0 AS p, chunk_id FROM top UNION ALL SELECT anchor, 1, chunk_id FROM hop), b AS (SELECT u.anchor, u.p, c.chunk_id, {_BLOCK} AS block FROM u JOIN c ON c.chunk_id = u.chunk_id)
SELECT anchor, count(*) AS n, sha256(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p, chunk_id)) AS context_hash FROM b GROUP BY anchor""")
def anchor_context(spark, d):
    top = graph.high_degree(R.edges(spark, d), 60).select(F.col("chunk_id").alias("query_id"), "chunk_id")
    near = graph.expand_neighbors(top, R.edges(spark, d), R.live_nodes(spark, d), 5)
    both = top.withColumn("p", F.lit(0)).unionByName(near.withColumn("p", F.lit(1)))
    b = both.join(R.chunks(spark, d), "chunk_id").select("query_id", F.struct("p", "chunk_id").alias("place"), context.block().alias("block"))
    return context.assembled(b, "query_id", "place", "block").select(F.col("query_id").alias("anchor"), "n", F.sha2("context", 256).alias("context_hash"))


@add(f"WITH {C}, {N}, {E}, t AS (SELECT count(*) AS n FROM e) SELECT 'chunks' AS what, count(*) AS n FROM c UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'edges:' || coalesce(edge_type, '?'), count(*) FROM e GROUP BY edge_type UNION ALL SELECT 'edges', n FROM t")
def store_stats(spark, d):
    return graph.store_stats(R.chunks(spark, d), R.live_nodes(spark, d), R.edges(spark, d))


@add(f"WITH {E} SELECT source_id AS chunk_id, count(target_id) AS degree FROM e WHERE edge_type = 'CALLS' AND source_id IS NOT NULL GROUP BY ALL HAVING count(target_id) >= 2 ORDER BY degree DESC, chunk_id LIMIT 60")
def high_degree(spark, d):
    return graph.high_degree(R.edges(spark, d), 60)


@add(f"WITH {R.FILES_SQL}, {C}, x AS (SELECT repo_name, count(*) AS n_files FROM f GROUP BY ALL), y AS (SELECT repo_name, count(*) AS n_chunks, count(DISTINCT file_path) AS files_with_chunks FROM c GROUP BY ALL) SELECT x.repo_name, n_files, coalesce(n_chunks, 0) AS n_chunks, coalesce(files_with_chunks, 0) AS files_with_chunks FROM x LEFT JOIN y USING (repo_name)")
def index_summary(spark, d):
    f = table(spark, d, "raw_files").dropDuplicates(["file_id"]).groupBy("repo_name").agg(F.count("*").alias("n_files"))
    c = R.chunks(spark, d).groupBy("repo_name").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("files_with_chunks"))
    return f.join(c, "repo_name", "left").fillna(0, ["n_chunks", "files_with_chunks"])
