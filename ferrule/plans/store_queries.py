"""Scans, projections, writes and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule import schemas
from ferrule.functions import names
from ferrule.operators import graph
from ferrule.plans import registry as R
from ferrule.runtime import table
from ferrule.sources import files as file_source
from ferrule.sources import store

CATALOG = R.Catalog()
add = CATALOG.add
TENANT = "granite-search"
C, N, E, FS, QA = R.CHUNKS_SQL, R.NODES_SQL, R.EDGES_SQL, R.FILES_SQL, R.QA_SQL


def filtered(df, repo: str, symbol: str | None = None, filename: str | None = None, language: str | None = None, chunk_type: str | None = None):
    """The rows of a repository that meet every condition that is given; the repository is a must."""
    if not repo:
        raise ValueError("a repository is required")
    return df.where(names.conjunction(F.col("repo_name") == repo, None if symbol is None else F.col("symbol_name") == symbol, None if filename is None else F.contains("file_path", F.lit(filename)), None if language is None else F.col("language") == language, None if chunk_type is None else F.col("chunk_type") == chunk_type))


@add(f"WITH {C} SELECT chunk_id, symbol_name, file_path, start_line, end_line FROM c WHERE repo_name = '{TENANT}' AND language = 'python' AND chunk_type = 'function' AND contains(file_path, 'src/')")
def scan_filter_tenant(spark, d):
    return filtered(R.chunks(spark, d), TENANT, filename="src/", language="python", chunk_type="function").select("chunk_id", "symbol_name", "file_path", "start_line", "end_line")


@add(f"WITH {C}, {N}, w AS (SELECT DISTINCT source_id AS id FROM edges WHERE source_id IS NOT NULL) SELECT id, id IN (SELECT chunk_id FROM c) AS in_chunks, id IN (SELECT chunk_id FROM n) AS in_nodes FROM w")
def point_exists(spark, d):
    wanted = table(spark, d, "edges").where("source_id is not null").select(F.col("source_id").alias("id")).distinct()
    c = R.chunks(spark, d).select(F.col("chunk_id").alias("id"), F.lit(True).alias("in_chunks"))
    n = R.live_nodes(spark, d).select(F.col("chunk_id").alias("id"), F.lit(True).alias("in_nodes")).distinct()
    return wanted.join(c, "id", "left").join(n, "id", "left").select("id", F.coalesce("in_chunks", F.lit(False)).alias("in_chunks"), F.coalesce("in_nodes", F.lit(False)).alias("in_nodes"))


@add(f"WITH {C}, {QA} SELECT q.qa_id, c.chunk_id FROM q JOIN c ON c.symbol_name = q._anchor_symbol AND contains(c.file_path, q._anchor_file)")
def fetch_by_symbol(spark, d):
    q = R.questions(spark, d).select("qa_id", F.col("_anchor_symbol").alias("symbol_name"), "_anchor_file")
    return q.join(R.chunks(spark, d), "symbol_name").where(F.contains("file_path", "_anchor_file")).select("qa_id", "chunk_id")


@add(f"WITH {C}, {QA}, w AS (SELECT DISTINCT unnest(expected_chunk_ids) AS chunk_id FROM q) SELECT c.chunk_id, c.symbol_name, c.repo_name FROM c SEMI JOIN w USING (chunk_id)")
def fetch_by_ids(spark, d):
    wanted = R.questions(spark, d).select(F.explode("expected_chunk_ids").alias("chunk_id")).distinct()
    return R.chunks(spark, d).join(wanted, "chunk_id", "left_semi").select("chunk_id", "symbol_name", "repo_name")


@add(f"WITH {C} SELECT repo_name, symbol_name, count(*) AS n, string_agg(chunk_id, ',' ORDER BY chunk_id) AS ids FROM c WHERE symbol_name IS NOT NULL GROUP BY ALL")
def name_map(spark, d):
    return R.chunks(spark, d).where("symbol_name is not null").groupBy("repo_name", "symbol_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("ids"))


@add(f"WITH {C} SELECT repo_name, chunk_id, symbol_name, array_to_string(calls_out_raw, '|') AS calls, array_to_string(imports_raw, '|') AS imports FROM c")
def metadata_scan(spark, d):
    return R.chunks(spark, d).select("repo_name", "chunk_id", "symbol_name", F.array_join("calls_out_raw", "|").alias("calls"), F.array_join("imports_raw", "|").alias("imports"))


@add(f"WITH {C} SELECT chunk_id, repo_name, coalesce(docstring, '') AS docstring, sha256('Symbol: ' || symbol_name || chr(10) || 'Docs: ' || coalesce(docstring, '') || chr(10) || text) AS content_hash, to_json(calls_out_raw)::VARCHAR AS calls_json FROM c WHERE vector_768 IS NOT NULL AND vector_128 IS NOT NULL")
def record_projection(spark, d):
    c = store.with_vectors(R.chunks(spark, d))
    return c.select("chunk_id", "repo_name", F.coalesce("docstring", F.lit("")).alias("docstring"), F.sha2(names.search_content("symbol_name", "docstring", "text"), 256).alias("content_hash"), F.to_json("calls_out_raw").alias("calls_json"))


@add(f"WITH {C} SELECT chunk_id, repo_name, symbol_name, chunk_type, language, file_path, docstring, start_line, end_line FROM c")
def node_projection(spark, d):
    return R.chunks(spark, d).select(*schemas.NODES.names)


@add(f"WITH {C} SELECT chunk_id, symbol_name, nullif(docstring, '') AS docstring, parent_class FROM c")
def model_projection(spark, d):
    return R.chunks(spark, d).select("chunk_id", "symbol_name", F.nullif("docstring", F.lit("")).alias("docstring"), "parent_class")


@add(f"WITH {C} SELECT chunk_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM c")
def snippet_projection(spark, d):
    return R.chunks(spark, d).select("chunk_id", names.snippet("text").alias("snippet"))


_IGNORED = ", ".join(f"'{x}'" for x in file_source.IGNORED_DIRS)


@add(f"""WITH {FS}, s AS (SELECT file_id, path, content, string_split(path, '/') AS parts, strlen(content) AS bytes FROM f)
SELECT file_id, path, CASE WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.js' THEN 'javascript' ELSE 'typescript' END AS language, bytes FROM s
WHERE regexp_matches(lower(path), '\\.(py|js|ts)$') AND bytes > 0 AND bytes <= 1048576 AND regexp_replace(content, '\\s+', '', 'g') <> ''
AND len(list_filter(parts[1:-2], lambda x: x IN ({_IGNORED}) OR (starts_with(x, '.')))) = 0""")
def file_admission(spark, d):
    f = R.files(spark, d)
    return f.where(file_source.admitted(F.col("path"), F.col("content"))).select("file_id", "path", file_source.language_of(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("bytes"))


@add(f"WITH {C} SELECT chunk_id, concat_ws('::', repo_name, replace(replace(file_path, '/', '.'), chr(92), '.'), coalesce(nullif(parent_class, ''), 'module') || '.' || symbol_name, left(sha256(coalesce(text, '')), 8)) AS made FROM c")
def chunk_id(spark, d):
    return R.chunks(spark, d).select("chunk_id", names.chunk_id("repo_name", "file_path", "parent_class", "symbol_name", "text").alias("made"))


_NODE_ROWS = "m AS (SELECT DISTINCT chunk_id, repo_name, symbol_name, docstring, indexed_at FROM nodes WHERE chunk_id IS NOT NULL)"


@add(f"WITH {C}, {_NODE_ROWS}, last AS (SELECT chunk_id, repo_name, symbol_name, docstring FROM m QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, docstring DESC NULLS LAST, symbol_name DESC NULLS LAST, repo_name DESC NULLS LAST) = 1) SELECT chunk_id, repo_name, symbol_name, docstring FROM c ANTI JOIN last USING (chunk_id) UNION ALL SELECT * FROM last")
def upsert_chunks(spark, d):
    base = R.chunks(spark, d).select("chunk_id", "repo_name", "symbol_name", "docstring")
    new = table(spark, d, "nodes").select("chunk_id", "repo_name", "symbol_name", "docstring", "indexed_at")
    return store.upsert(base, new, "chunk_id", [F.col(c) for c in ("indexed_at", "docstring", "symbol_name", "repo_name")])


@add(f"WITH {N}, {E} SELECT source_id, target_id, edge_type FROM e WHERE source_id IN (SELECT chunk_id FROM n) AND target_id IN (SELECT chunk_id FROM n)")
def edge_insert_checked(spark, d):
    return graph.checked_edges(table(spark, d, "edges"), R.live_nodes(spark, d))


@add(f"WITH {N}, b AS (SELECT edge_type, coalesce(source_id IN (SELECT chunk_id FROM n) AND target_id IN (SELECT chunk_id FROM n), false) AS ok FROM (SELECT DISTINCT ON (edge_id) * FROM edges)) SELECT edge_type, count(*) FILTER (ok) AS upserted, count(*) FILTER (NOT ok) AS skipped FROM b GROUP BY edge_type")
def edge_insert_stats(spark, d):
    return graph.insert_stats(table(spark, d, "edges").dropDuplicates(["edge_id"]), R.live_nodes(spark, d))


@add(f"WITH {E} SELECT * FROM e WHERE source_id IS NULL OR NOT starts_with(source_id, '{TENANT}::')")
def delete_tenant_edges(spark, d):
    return store.without_tenant_edges(R.edges(spark, d), TENANT)


@add(f"WITH {C} SELECT repo_name, count(*) AS n FROM c WHERE repo_name IS NULL OR repo_name <> '{TENANT}' GROUP BY ALL")
def purge_tenant(spark, d):
    return store.without_tenant(R.chunks(spark, d), TENANT).groupBy("repo_name").agg(F.count("*").alias("n"))


@add(f"WITH {N}, {E}, g AS (SELECT chunk_id FROM n WHERE repo_name = '{TENANT}') SELECT 'node' AS what, chunk_id AS a, NULL AS b FROM n WHERE repo_name <> '{TENANT}' UNION ALL SELECT 'edge', source_id, target_id FROM e WHERE NOT coalesce(source_id IN (SELECT * FROM g), false) AND NOT coalesce(target_id IN (SELECT * FROM g), false)")
def detach_delete(spark, d):
    nodes, edges = store.detached(R.live_nodes(spark, d), R.edges(spark, d), TENANT)
    return nodes.select(F.lit("node").alias("what"), F.col("chunk_id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(edges.select(F.lit("edge").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@add(f"WITH {FS}, {C} SELECT file_id, repo_name, path FROM f ANTI JOIN (SELECT DISTINCT repo_name, file_path AS path FROM c) USING (repo_name, path)")
def wal_pending(spark, d):
    done = R.chunks(spark, d).select("repo_name", F.col("file_path").alias("path"))
    return store.pending(R.files(spark, d), done).select("file_id", "repo_name", "path")


@add(f"WITH {FS} SELECT DISTINCT repo_name || '::file_indexed::language=' || language || ',path=' || path AS key FROM f")
def wal_keys(spark, d):
    f = R.files(spark, d)
    key = store.wal_key(F.col("repo_name"), F.lit("file_indexed"), F.create_map(F.lit("path"), F.col("path"), F.lit("language"), F.col("language")))
    return f.select(key.alias("key")).distinct()
