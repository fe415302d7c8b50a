import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import search
from ferrule.plans import catalog


@pytest.fixture(scope="module")
def vecs(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(300, 8)).round(3)
    m[5] = m[4]
    m[6] = 0
    rows = [(i, [float(x) for x in v], "r") for i, v in enumerate(m)] + [(900, None, "r"), (901, [1.0], "r"), (4, [float(x) for x in m[4]], "r")]
    return m, spark.createDataFrame(rows, "i long, v array<double>, score string")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_topk_is_exact(vecs, metric):
    m, df = vecs
    got = search.vector_topk(df.where("i % 50 = 0"), df, "i", "i", "v", 5, metric)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append(r["row_id"])
    for q in range(0, 300, 50):
        s = m @ m[q]
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                s = s / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[q]))
        elif metric == "euclidean":
            s = -np.linalg.norm(m - m[q], axis=1)
        want = sorted((i for i in range(300) if np.isfinite(s[i])), key=lambda i: (-round(float(s[i]), 9), i))[:5]
        assert by[q] == want
    assert search.vector_topk(df.limit(0), df, "i", "i", "v", 5).count() == 0
    assert search.vector_topk(df.where("i = 0"), df.limit(0), "i", "i", "v", 5).count() == 0
    with pytest.raises(ValueError):
        search.vector_topk(df, df, "i", "i", "v", 5, "x")


def test_score_matrix(vecs):
    m, df = vecs
    got = {(r["query_id"], r["row_id"]): r for r in search.score_matrix(df.where("i in (0, 50)"), df, "i", "i", "v").collect()}
    assert len(got) == 600 and got[0, 6]["cosine"] is None and got[0, 0]["euclidean"] == 0
    assert got[0, 7]["dot"] == pytest.approx(m[0] @ m[7]) and got[0, 7]["cosine"] == pytest.approx(m[0] @ m[7] / np.linalg.norm(m[0]) / np.linalg.norm(m[7]))
    assert search.score_matrix(df.limit(0), df, "i", "i", "v").count() == 0


def test_cascade_and_ann(vecs):
    m, df = vecs
    whole = df.where("size(v) = 8 and i <> 6")
    exact = {(r["query_id"], r["row_id"]) for r in search.vector_topk(whole.where("i % 50 = 0"), whole, "i", "i", "v", 5, "dot").collect()}
    wide = {(r["query_id"], r["row_id"]) for r in search.cascade(whole.where("i % 50 = 0"), whole, "i", "i", "v", 4, 5, 299).collect()}
    assert wide == exact
    near = {(r["query_id"], r["row_id"]) for r in search.vector_topk(whole.where("i % 50 = 0"), whole, "i", "i", "v", 5).collect()}
    ann = {(r["query_id"], r["row_id"]) for r in search.ann_topk(whole.where("i % 50 = 0"), whole, "i", "i", "v", 5, min_rows=256, probes=10).collect()}
    assert len(near & ann) / len(near) >= 0.9
    assert {(r["query_id"], r["row_id"]) for r in search.ann_topk(whole.where("i % 50 = 0"), whole, "i", "i", "v", 5, min_rows=1000).collect()} == near


def test_registered_ann_equals_exact_search(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").dropDuplicates(["vec_id"])
    exact = search.vector_topk(rows.where("vec_id % 50 = 0"), rows, "vec_id", "vec_id", "embedding", 5)
    got = catalog.queries()["ann_topk"](spark, d)
    key = lambda df: {(r["query_id"], r["row_id"], r["rank"]) for r in df.collect()}
    assert rows.count() > 256 and key(got) == key(exact)


def test_bm25(spark):
    rows = [("a", 1, "red fish blue fish"), ("a", 2, "red"), ("a", 3, ""), ("a", 4, None), ("b", 5, "red fish"), ("a", 2, "red")]
    df = spark.createDataFrame(rows, "repo string, i long, t string")
    q = spark.createDataFrame([("a", 10, "Fish red"), ("a", 11, "nothing"), ("b", 12, None)], "repo string, q long, t string")
    got = search.bm25_topk(q, df, "q", "t", "i", "t", 5, "repo", "repo").collect()
    assert [(r["query_id"], r["row_id"], r["rank"]) for r in got] == [(10, 1, 0), (10, 2, 1)]
    n, avgdl = 2, 2.5
    idf = lambda d: np.log(1 + (n - d + 0.5) / (d + 0.5))
    gain = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert got[0]["score"] == pytest.approx(idf(1) * gain(2, 4) + idf(2) * gain(1, 4))
    assert search.bm25_topk(q, df.limit(0), "q", "t", "i", "t", 5).count() == 0
    assert {(r["term"], r["row_id"], r["tf"]) for r in search.postings(df.where("repo = 'b'"), "i", "t").collect()} == {("red", 5, 1), ("fish", 5, 1)}


def written(spark):
    """Bytes that were shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_bm25_does_not_shuffle_pairs(spark, monkeypatch):
    import random

    r = random.Random(3)
    texts = [(f"t{i:04d}", "the " * (1 + i % 3) + r.choice(["red", "blue", "green"]) + " fish" * r.randrange(3)) for i in range(3_000)]
    asks = [(i, f"the {r.choice(['red', 'blue', 'grey'])} {r.choice(['fish', 'bird'])}") for i in range(300)]
    df = spark.createDataFrame([*texts, *texts[:50]], "i string, t string").repartition(4)
    q = spark.createDataFrame(asks, "q long, t string")
    monkeypatch.setattr(search, "QUESTION_BLOCK", 170)
    monkeypatch.setattr(search, "SCORES", 10_000)
    before, got = written(spark), {}
    for x in search.bm25_topk(q, df, "q", "t", "i", "t", 5).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["row_id"], round(x["score"], 9))
    assert written(spark) - before < 2_000_000
    bags = {i: t.split() for i, t in texts}
    avgdl = sum(map(len, bags.values())) / len(bags)
    df_of = {w: sum(w in b for b in bags.values()) for w in "the red blue grey fish bird".split()}
    best = {}
    for i, t in asks:
        if t not in best:
            score = {j: sum(np.log(1 + (3_000 - df_of[w] + 0.5) / (df_of[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / avgdl)) for w in t.split()) for j, b in bags.items()}
            best[t] = sorted(((-round(s, 9), j) for j, s in score.items() if s > 0))[:5]
        assert [got[i][n][0] for n in range(5)] == [j for _, j in best[t]]
        assert [got[i][n][1] for n in range(5)] == pytest.approx([-s for s, _ in best[t]], abs=2e-9)


def test_bm25_sums_over_all_scopes_of_a_query(spark):
    df = spark.createDataFrame([("a", "x", "red fish"), ("b", "x", "red"), ("b", "y", "red"), (None, "z", "red"), ("c", "z", "red"), ("c", "v", "...")], "repo string, i string, t string")
    q = spark.createDataFrame([("a", 1, "red"), ("b", 1, "red"), (None, 2, "red"), ("c", 3, "blue")], "repo string, q long, t string")
    got = {(x["query_id"], x["row_id"]): x["score"] for x in search.bm25_topk(q, df, "q", "t", "i", "t", 5, "repo", "repo").collect()}
    gain = lambda n, d, dl, avgdl: np.log(1 + (n - d + 0.5) / (d + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert got == {(1, "x"): pytest.approx(gain(1, 1, 2, 2) + gain(2, 2, 1, 1)), (1, "y"): pytest.approx(gain(2, 2, 1, 1))}


def test_rrf(spark):
    a = spark.createDataFrame([(0, c, i) for i, c in enumerate(["c1", "c2", "c3"])], "query_id int, row_id string, rank int")
    b = spark.createDataFrame([(0, c, i) for i, c in enumerate(["c3", "c4", "c1"])], "query_id int, row_id string, rank int")
    got = search.rrf(a, b, 4).orderBy("rank").collect()
    assert [(r["row_id"], round(r["rrf_score"], 9)) for r in got] == [("c1", 0.032795699), ("c3", 0.032795699), ("c2", 0.016393443), ("c4", 0.016393443)]
    assert [r["row_id"] for r in search.rrf(a, b.limit(0), 2).orderBy("rank").collect()] == ["c1", "c2"]


def test_rerank(spark):
    h = spark.createDataFrame([(0, "x", "a b"), (0, "y", "a"), (0, "z", None)], "query_id int, row_id string, t string")
    got = search.rerank(h, search.overlap_score(F.lit("a b"), "t"), 2).orderBy("rank").collect()
    assert [r["row_id"] for r in got] == ["x", "y"]


def test_registered_rerank_does_not_shuffle_pairs(spark):
    before = written(spark)
    got = catalog.queries()["rerank"](spark, "/root/testdata/sf0.1").collect()
    assert len({(r["query_id"], r["rank"]) for r in got}) == len(got) > 250
    assert written(spark) - before < 20_000_000


def test_registered_rerank_shuffles_less_than_pairs_of_many_questions(spark, tmp_path):
    import random

    import duckdb

    r = random.Random(5)
    text = lambda n: "the index of " + " ".join(f"w{x}" for x in r.choices(range(40), k=n))
    chunks = [(f"c{i:04d}", f"f{i % 7}", None if i % 3 else "the docs", text(6) if i % 90 else None) for i in range(2_000)]
    spark.createDataFrame([*chunks, *chunks[:50]], "chunk_id string, symbol_name string, docstring string, text string").repartition(4).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(25 * i, f"Where is {text(3)}?" if i % 60 else None) for i in range(800)], "qa_id long, question string").write.parquet(f"{tmp_path}/qa_pairs.parquet")
    before = written(spark)
    got = catalog.queries()["rerank"](spark, str(tmp_path)).collect()
    assert written(spark) - before < 2_000_000  # 386 questions by nearly 2,000 rows that share words with each
    con = duckdb.connect()
    for t in ("chunks", "qa_pairs"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"select query_id, rank, row_id, reranker_score from ({catalog.oracle_sql()['rerank']})").fetchall()
    assert sorted((x["query_id"], x["rank"], x["row_id"], x["reranker_score"]) for x in got) == sorted(want) and len(want) > 1_900


def test_topk_plan_pushes_columns(spark, sf):
    df = spark.read.parquet(f"{sf}/chunks.parquet").where("repo_name = 'x'").select("chunk_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(repo_name)" in plan and "vector" not in plan


def test_scoped_topk_against_plain_loops(spark):
    import random

    from ferrule.operators import search

    r = random.Random(2)
    vec = lambda: [r.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)]
    rows = [(f"c{i:03d}", r.choice("ab"), vec() if i % 9 else None, r.choice(["f", "g", None]), r.choice(["src/x.py", "lib/x.py", "y.js", None]), r.choice(["python", "javascript"])) for i in range(120)]
    asked = [(i, r.choice(["a", "b", "none", None]), vec() if i % 7 else None, r.choice([None, "f", " "]), r.choice([None, "x.py"]), r.choice([None, "python"])) for i in range(30)]
    df = spark.createDataFrame([*rows, *rows[:20]], "row_id string, scope string, v array<double>, symbol_name string, file_path string, language string").repartition(5)
    q = spark.createDataFrame(asked, "query_id int, scope string, v array<double>, symbol string, filename string, language string")
    got: dict = {}
    for x in search.scoped_topk(q, df, 4).collect():
        got.setdefault(x["query_id"], []).append((-x["score"], x["row_id"]))
    for i, scope, v, symbol, name, lang in asked:
        fit = [(-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, s, w, sym, path, la in rows if v and w and s == scope and (not (symbol or "").strip() or sym == symbol) and (not name or (path or "").endswith(name)) and (not lang or la == lang)]
        assert sorted(got.get(i, [])) == sorted(fit)[:4]
    assert search.scoped_topk(q.limit(0), df, 4).count() == 0 and search.scoped_topk(q, df.limit(0), 4).count() == 0


def test_retrieve_obeys_the_gate(spark):
    from ferrule.plans.engine import retrieve

    chunk = lambda i, sym, path="a.py", lang="python": (f"c{i:02d}", "r", sym, path, lang, "", f"text {i} words", [1.0, float(i)])
    rows = [chunk(i, "many") for i in range(12)] + [chunk(20, "one"), chunk(21, "one", "b.js", "javascript"), chunk(22, "other")]
    chunks = spark.createDataFrame(rows, "chunk_id string, repo_name string, symbol_name string, file_path string, language string, docstring string, text string, vector_768 array<double>")
    ask = [(1, "one"), (2, "many"), (3, "absent"), (4, None), (5, "one")]
    req = spark.createDataFrame([(i, "words", "r", [1.0, 0.0], s, "b.js" if i == 5 else None) for i, s in ask], "query_id int, question string, repo_name string, vector_768 array<double>, symbol string, filename string")
    got: dict = {}
    for x in retrieve(req, chunks, 3, 5, 2).collect():
        got.setdefault(x["query_id"], []).append((x["source"], x["row_id"]))
    assert sorted(got[1]) == [("symbol_lookup", "c20"), ("symbol_lookup", "c21")] and got[5] == [("symbol_lookup", "c21")]
    assert {s for i in (2, 3, 4) for s, _ in got[i]} == {"hybrid"} and all(len(got[i]) == 3 for i in (2, 3, 4))
