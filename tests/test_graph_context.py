import pytest
from pyspark.sql import functions as F

from ferrule.operators import context, evaluation, graph


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_resolution(spark):
    chunks = frame(spark, [("r", "f", "s1"), ("r", "f", "s2"), ("r2", "f", "o1"), ("r", None, "s3")], "repo_name string, symbol_name string, chunk_id string")
    raw = frame(spark, [("r", "s1", "f", "CALLS"), ("r", "s1", "os.path", "CALLS"), ("r", "s1", "self.f", "CALLS")], "repo_name string, source_id string, target_name string, edge_type string")
    assert [tuple(r) for r in graph.resolve_edges(raw, chunks).collect()] == [("s1", "s2", "CALLS")]
    assert tuple(graph.resolution_stats(raw, chunks).first()) == ("r", 2, 1)
    assert graph.resolve_edges(raw.limit(0), chunks).count() == 0


def test_expansion_keeps_tenants_apart(spark):
    edges = frame(spark, [("a", "b", "CALLS"), ("a", "c", "CALLS"), ("b", "c", "IMPORTS"), ("c", "d", "CALLS"), ("a", "x", "CALLS"), (None, "a", "CALLS"), ("a", None, "CALLS")], "source_id string, target_id string, edge_type string")
    nodes = frame(spark, [(i, "r") for i in "abcd"] + [("x", "other"), ("a", "r")], "chunk_id string, repo_name string")
    seeds = frame(spark, [(1, "a"), (1, "b"), (1, "a")], "query_id int, chunk_id string")
    assert [tuple(r) for r in graph.expand_neighbors(seeds, edges, nodes).collect()] == [(1, "c")]
    assert [r["caller_id"] for r in graph.callers(frame(spark, [("c",), (None,)], "chunk_id string"), edges).collect()] == ["a"]
    assert {tuple(r) for r in graph.checked_edges(edges.unionByName(edges), nodes).collect()} == {("a", "b", "CALLS"), ("a", "c", "CALLS"), ("b", "c", "IMPORTS"), ("c", "d", "CALLS"), ("a", "x", "CALLS")}
    assert {tuple(r) for r in graph.insert_stats(edges, nodes).collect()} == {("CALLS", 4, 2), ("IMPORTS", 1, 0)}
    assert [tuple(r) for r in graph.high_degree(edges, 5).collect()] == [("a", 3)]
    assert {tuple(r) for r in graph.store_stats(nodes, nodes, edges).collect()} == {("chunks", 6), ("nodes", 6), ("edges:CALLS", 6), ("edges:IMPORTS", 1), ("edges", 7)}


def test_calls_and_lists(spark):
    df = frame(spark, [(["print", "a.b", "a.c", "z"], '["x"]'), (None, "broken"), ([], None)], "calls array<string>, j string")
    assert [r["o"] for r in df.select(graph.call_names("calls").alias("o")).collect()] == [["a", "z"], [], []]
    assert [r["o"] for r in df.select(graph.decode_list("j").alias("o")).collect()] == [["x"], [], []]


def test_merge_and_gate(spark):
    a = frame(spark, [(1, "x", 0, "hybrid"), (1, "y", 1, "hybrid")], "query_id int, chunk_id string, pos int, source string")
    b = frame(spark, [(1, "y", 0, "graph_expand"), (1, "z", 1, "graph_expand")], "query_id int, chunk_id string, pos int, source string")
    assert [(r["chunk_id"], r["source"]) for r in graph.merge_hits(a, b).orderBy("order").collect()] == [("x", "hybrid"), ("y", "hybrid"), ("z", "graph_expand")]
    chunks = frame(spark, [("r", "f", str(i)) for i in range(11)] + [("r", "g", "q")], "repo_name string, symbol_name string, chunk_id string")
    req = frame(spark, [(1, "f", "r"), (2, "g", "r"), (3, "h", "r"), (4, None, "r"), (5, "g", "r2")], "query_id int, symbol string, repo_name string")
    assert {r["query_id"]: r["gate"] for r in graph.symbol_gate(req, chunks).collect()} == {1: "hybrid", 2: "symbol", 3: "hybrid", 4: "hybrid", 5: "hybrid"}


@pytest.mark.parametrize(("q", "want"), [("how does dependency injection work?", "code_search"), ("why is this slow?", "debugging"), ("How do I set up the environment?", "setup"), ("prune the tree", "setup"), ("hello", "conceptual"), (None, "conceptual")])
def test_route(spark, q, want):
    assert frame(spark, [(q,)], "q string").select(context.route(F.col("q"))).first()[0] == want


@pytest.mark.parametrize(("hits", "want"), [("rrrrrnn", "0156234"), ("rrn", "012"), ("n", "0"), ("rrrn", "0312")])
def test_interleave(spark, hits, want):
    rows = [(1, str(i), "graph_expand" if c == "n" else "hybrid", i) for i, c in enumerate(hits)]
    got = context.interleave(frame(spark, rows, "query_id int, chunk_id string, source string, order int")).orderBy("place").collect()
    assert "".join(r["chunk_id"] for r in got) == want


def test_budget_stops_at_the_first_overflow(spark):
    df = frame(spark, [(1, i, "x" * n) for i, n in enumerate([20000, 15000, 10])], "k int, p int, t string")
    kept = context.within_budget(df, "k", "p", "t")
    assert [r["p"] for r in kept.collect()] == [0]
    assert tuple(context.assembled(frame(spark, [(1, 1, "b"), (1, 0, "a")], "k int, p int, t string"), "k", "p", "t").first()) == (1, "a\n\n---\n\nb", 2)


def test_block_and_prompt(spark):
    df = frame(spark, [("p.py", "function", "f", "D" * 120, "body"), ("p.py", "function", "f", None, None)], "file_path string, chunk_type string, symbol_name string, docstring string, text string")
    a, b = (r[0] for r in df.select(context.block()).collect())
    assert a == "# File: p.py | function: f\n# Purpose: " + "D" * 100 + "\nbody" and b == "# File: p.py | function: f\n"
    q = frame(spark, [("setup", None, "go?")], "r string, c string, q string").select(context.prompt(F.col("r"), F.col("c"), F.col("q"))).first()[0]
    assert q.endswith("Task: go?")


def test_measures(spark):
    df = frame(spark, [(["a", "b", "c"], ["a", "c", "z"], "Reasoning: ok\nScore: 0.8", "x"), (None, None, "none", None), (["a"], [], "Score: 1", " ")], "r array<string>, e array<string>, j string, t string")
    got = df.select(evaluation.precision_at_k(F.col("r"), F.col("e")).alias("p"), evaluation.context_recall(F.col("r"), F.col("e")).alias("c"), evaluation.judge_score(F.col("j")).alias("j"), evaluation.answer_cosine(F.col("t"), F.lit("c"), F.array(F.lit(1.0)), F.array(F.lit(0.5))).alias("a")).collect()
    assert [(round(r["p"], 6), round(r["c"], 6), r["j"], r["a"]) for r in got] == [(0.4, 0.666667, 0.8, 0.5), (0.0, 0.0, None, 0.0), (0.0, 0.0, 1.0, 0.0)]
    m = frame(spark, [(None, 1.0), (None, None), (None, 0.5)], "x double, y double").agg(evaluation.mean(F.col("x")).alias("x"), evaluation.mean(F.col("y")).alias("y")).first()
    assert tuple(m) == (0.0, 0.75)
    r = frame(spark, [('```json\n{"question": "q", "answer": "a"}\n```',), ("broken",), (None,)], "s string").select(evaluation.qa_fields(F.col("s")).alias("o")).collect()
    assert r[0]["o"]["question"] == "q" and (r[1]["o"] is None or r[1]["o"]["question"] is None) and r[2]["o"] is None
    s = evaluation.eval_summary(frame(spark, [(1.0, 0.5, 0.2, None, 3.0)], "precision_at_5 double, context_recall double, answer_relevance double, faithfulness double, latency_ms double")).first()
    assert s["n"] == 1 and s["faithfulness"] == 0.0
