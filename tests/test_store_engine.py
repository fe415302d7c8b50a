import json

import pytest
from pyspark.sql import functions as F

from ferrule.config import Settings
from ferrule.plans import engine, observe
from ferrule.plans.cache import Cache
from ferrule.sources import files, store
from ferrule.streaming.ingest import run_ingest


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("b", 5), (None, 9)], "k string, v int")
    once = store.upsert(base, new, "k", [F.col("v")])
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 5), ("c", 4)}
    assert {tuple(r) for r in store.upsert(once, new, "k", [F.col("v")]).collect()} == {tuple(r) for r in once.collect()}
    assert store.upsert(base.limit(0), new.limit(0), "k").count() == 0


def test_purges(spark):
    nodes = spark.createDataFrame([("r::a", "r"), ("s::b", "s")], "chunk_id string, repo_name string")
    edges = spark.createDataFrame([("r::a", "s::b"), ("s::b", "s::b"), ("s::b", "r::a")], "source_id string, target_id string")
    n, e = store.detached(nodes, edges, "r")
    assert [tuple(x) for x in n.collect()] == [("s::b", "s")] and [tuple(x) for x in e.collect()] == [("s::b", "s::b")]
    assert store.without_tenant_edges(edges, "r").count() == 2
    assert store.without_tenant(nodes, "r").count() == 1


def test_log(spark, tmp_path):
    log = store.WriteLog(spark, str(tmp_path / "wal"))
    assert log.done().count() == 0
    rows = spark.createDataFrame([("r", "file_indexed", {"path": "a", "hash": "h"}), ("s", "edges_written", {})], "repo string, op string, kwargs map<string,string>")
    log.record(rows)
    (tmp_path / "wal" / "part-x.json").write_text('{"repo": broken\n')
    assert {r["key"] for r in log.done().collect()} == {"r::file_indexed::hash=h,path=a", "s::edges_written::"}
    log.clear("r")
    assert {r["key"] for r in log.done().collect()} == {"s::edges_written::"}
    log.clear()
    assert log.done().count() == 0


def test_directory_source(spark, tmp_path):
    for p, b in {"a.py": b"x = 1\n", "sub/B.JS": b"let x\xff = 1;", "node_modules/c.js": b"x", "tests/t.py": b"x", ".hid/d.py": b"x", "e.md": b"x", "blank.py": b"  \n", "empty.py": b"", "big.ts": b"y" * 2000}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(b)
    got = {r["path"]: r for r in files.directory(spark, str(tmp_path), "r", 1000).collect()}
    assert set(got) == {"a.py", "sub/B.JS"}
    assert got["sub/B.JS"]["content"] == "let x = 1;" and got["sub/B.JS"]["language"] == "javascript"


def test_json_sources(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"question": "q", "expected_chunk_ids": ["a"]}\n\n')
    assert files.golden_set(spark, str(tmp_path / "g.jsonl")).first()["expected_chunk_ids"] == ["a"]
    (tmp_path / "e.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.golden_set(spark, str(tmp_path / "e.jsonl"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.golden_set(spark, str(tmp_path / "missing.jsonl"))
    files.write_document({"n": 1}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 1}
    docs = files.append_documents(files.append_documents(None, spark, [("a", {"title": "x"})]), spark, [("b", {})])
    assert docs.count() == 2


def test_engine_end_to_end(spark, tmp_path):
    e = engine.Engine(spark, store.TableStore(spark, str(tmp_path / "t")), store.WriteLog(spark, str(tmp_path / "wal")), Settings(), engine.HashEmbedder(768))
    src = "def load_rows(path):\n    '''Load rows from a file.'''\n    return parse_rows(path)\n\ndef parse_rows(x):\n    return x\n"
    fs = spark.createDataFrame([("r", "a.py", src, "python"), ("r2", "a.py", "def parse_rows(x):\n    return x\n", "python")], "repo_name string, path string, content string, language string")
    got = e.index(fs)
    assert (got["files_processed"], got["files_skipped"], got["total_chunks"]) == (2, 0, 3)
    assert e.index(fs)["files_processed"] == 0
    assert {(r["source_id"].split("::")[0], r["target_id"].split("::")[0]) for r in e.store.read("edges").collect()} == {("r", "r")}
    assert e.health()["chunks"] == 3
    a = e.answer("How does load_rows read the file?", "r")
    assert a["route"] == "code_search" and a["chunks"] == 2 and "load_rows" in a["answer"]
    ids = [r["chunk_id"] for r in e.store.read("chunks").where("repo_name = 'r'").collect()]
    gold = spark.createDataFrame([(1, "load_rows rows file", "r", ids)], "query_id int, question string, repo_name string, expected_chunk_ids array<string>")
    assert e.evaluate(gold).first()["context_recall"] == 1.0
    e.generate = lambda p: ('{"question": "q?", "answer": "a"}' if "JSON" in p else "Score: 0.5", 1)
    g = e.golden(1)
    assert g.count() == 0  # the one caller has a single call
    e.store.write("edges", e.store.read("edges").unionByName(spark.createDataFrame([(ids[0], "r::other", "CALLS"), (ids[0], "r::third", "CALLS")], "source_id string, target_id string, edge_type string")))
    assert e.golden(1).first()["ground_truth_answer"] == "a"
    e.settings = Settings(judge_rate=1.0)
    assert e.judged(spark.createDataFrame([(1, "a", "c")], "query_id int, answer string, context string")).first()["faithfulness"] == 0.5
    first = e.cached_answer("How does load_rows read the file?", "r")
    assert e.cached_answer("How does load_rows read the file?", "r") is first and e.cache.hits == 1
    e.store.compact("chunks")
    e.store.purge("r")
    assert e.health()["chunks"] == 1 and e.store.read("edges").count() == 0


def test_engine_stores_files_without_a_parser(spark, tmp_path):
    e = engine.Engine(spark, store.TableStore(spark, str(tmp_path / "t")), store.WriteLog(spark, str(tmp_path / "wal")), Settings(window_chars=40, window_stride=30), engine.HashEmbedder(768))
    text = "replicas: 3\nimage: registry/worker:7\nport: 8080\nqueue: orders\n"
    fs = spark.createDataFrame([("r", "deploy.yaml", text, "unknown")], "repo_name string, path string, content string, language string")
    got = e.index(fs)
    assert (got["files_processed"], got["total_chunks"]) == (1, 3)
    assert {r["text"] for r in e.store.read("chunks").collect()} == {text[:40], text[30:70], text[60:]}
    assert e.store.read("edges").count() == 0 and "worker" in e.answer("Which image has the worker?", "r")["answer"]


def test_engine_keeps_failures(spark, tmp_path):
    e = engine.Engine(spark, store.TableStore(spark, str(tmp_path / "t")), store.WriteLog(spark, str(tmp_path / "wal")), Settings(judge_rate=1.0), engine.HashEmbedder(768))
    fs = spark.createDataFrame([("r", "a.py", "def read_rows(path):\n    return open(path)\n", "python"), ("r", "b.py", "def broken(:\n", "python")], "repo_name string, path string, content string, language string")
    got = e.index(fs)
    assert (got["files_processed"], got["files_failed"], got["total_chunks"]) == (2, 1, 1)
    assert [(r["op"], r["kwargs"]["path"]) for r in e.log.entries().where("op = 'parse_failed'").collect()] == [("parse_failed", "b.py")]
    again = e.index(fs)  # only what failed is tried again
    assert (again["files_processed"], again["files_failed"]) == (1, 1)
    ids = [r["chunk_id"] for r in e.store.read("chunks").collect()]
    gold = spark.createDataFrame([(1, "How does read_rows open the path?", "r", ids), (2, "What fails?", "r", ids)], "query_id int, question string, repo_name string, expected_chunk_ids array<string>")

    def generate(prompt):
        if "What fails?" in prompt and "Score" not in prompt:
            raise RuntimeError("no model")
        return ("Score: 0.5" if "Score" in prompt else "read_rows opens the path", 1)

    e.generate = generate
    rows = {r["query_id"]: r for r in e.evaluated(gold).collect()}
    assert rows[1]["error"] is None and rows[1]["context_recall"] == 1.0 and rows[1]["faithfulness"] == 0.5 and rows[1]["answer_relevance"] > 0 and rows[1]["latency_ms"] > 0
    assert "no model" in rows[2]["error"] and rows[2]["context_recall"] == 0.0 and rows[2]["chunks_retrieved"] == 1
    m = e.evaluate(gold).first()
    assert m["n"] == 2 and m["context_recall"] == 0.5
    assert e.relevance(spark.createDataFrame([(1, "q", "a")], "query_id int, question string, answer string")).first()["relevance"] == 0.5
    asked = spark.createDataFrame([(1, "How?", "r", "read_rows")], "query_id int, question string, repo_name string, symbol string")
    assert [(x["chunk_id"], x["source"]) for x in e.query(asked).first()["sources"]] == [(ids[0], "symbol_lookup")]
    assert e.nearest(gold).where("query_id = 1").first()["row_id"] == ids[0]


def test_stream_ingest(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([(1, "a")], "k int, v string").schema
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "x")], "k int, v string").write.parquet(src)
    run_ingest(spark, src, schema, ["k"], out, str(tmp_path / "s"))
    spark.createDataFrame([(2, "b"), (3, "c"), (2, "changed")], "k int, v string").write.mode("append").parquet(src)
    run_ingest(spark, src, schema, ["k"], out, str(tmp_path / "s"))
    assert {(r["k"], r["v"]) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "b"), (3, "c"), (2, "changed")}


def test_cache_and_steps(spark):
    c = Cache(2)
    for k in "aba":
        c.get("answer", (k,), lambda k=k: k)
    c.get("answer", ("c",), lambda: "c")
    assert list(c.kept["answer"]) == [("a",), ("c",)] and c.hits == 1
    c.clear()
    assert not c.kept["answer"]
    with pytest.raises(KeyError):
        c.get("other", (), lambda: 1)
    with observe.timed("step") as step:
        df, seen = observe.counted(spark.range(7), "rows")
        df.collect()
    assert seen.get["rows"] == 7 and step.latency_ms > 0
