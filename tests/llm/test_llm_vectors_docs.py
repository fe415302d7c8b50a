import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import docpairs, neighbors

DIM = 32


@pytest.fixture(scope="module")
def clusters(spark):
    r = np.random.default_rng(0)
    centers = r.normal(size=(60, DIM))
    m = np.concatenate([c + 0.35 * r.normal(size=(12, DIM)) for c in centers]).astype(np.float32)
    m[100] = m[101] = m[102]
    m[200] = 2 * m[201]
    rows = [(f"c{i:04d}", [float(x) for x in v], i, "x") for i, v in enumerate(m)]
    rows += [("null", None, 0, "x"), ("short", [1.0], 0, "x"), ("zero", [0.0] * DIM, 0, "x"), ("nan", [float("nan")] * DIM, 0, "x"), (None, [1.0] * DIM, 0, "x"), rows[7], rows[7]]
    return m, spark.createDataFrame(rows, "id string, v array<float>, cosine int, neighbor string")


def brute(m, k, least):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u.astype(np.float64) @ u.T.astype(np.float64), 6)
    np.fill_diagonal(s, -2)
    return {(f"c{i:04d}", f"c{j:04d}") for i in range(len(m)) for j in sorted(range(len(m)), key=lambda j: (-s[i, j], j))[:k] if s[i, j] >= least}


@pytest.mark.parametrize("leaf", [100_000, 120])
def test_recall(clusters, leaf):
    m, df = clusters
    got = {(r["id"], r["neighbor"]) for r in neighbors.nearest_neighbors(df, "id", "v", DIM, 5, 0.5, leaf_members=leaf).collect()}
    want = brute(m, 5, 0.5)
    assert len(got & want) / len(want) >= (0.999 if leaf > 1000 else 0.9)
    assert len(got - want) <= 0.1 * len(got)


@pytest.mark.parametrize(("fitted", "hot", "exact"), [(1, 10_000, False), (10, 40, False), (1, 30, False), (10, 100, True)])
def test_deep_trees_and_hot_leaves(clusters, monkeypatch, fitted, hot, exact):
    monkeypatch.setattr(neighbors, "FITTED_LEVELS", fitted)
    monkeypatch.setattr(neighbors, "HOT_LEAF", hot)
    m, df = clusters
    rows = [(r["id"], r["neighbor"]) for r in neighbors.nearest_neighbors(df, "id", "v", DIM, 5, 0.5, leaf_members=150, exact=exact).collect()]
    want = brute(m, 5, 0.5)
    assert len(rows) == len(set(rows)) and len(set(rows) & want) / len(want) >= (0.999 if exact else 0.95)
    assert len(set(rows) - want) <= 0.05 * len(rows)


def test_many_leaves_keep_neighbors_together():
    r = np.random.default_rng(4)
    m = np.repeat(r.normal(size=(8_000, 256)), 2, axis=0) + 0.35 * r.normal(size=(16_000, 256))
    u = neighbors.unit(m.astype(np.float32))
    forest = neighbors.fit_forest(u[r.choice(len(u), 4_096, replace=False)], 2, 11, 7)
    leaves = np.concatenate([neighbors.best_leaves(x, forest, 4) for x in np.split(u, 8)])
    together = (leaves[::2, :, None] == leaves[1::2, None, :]).any((1, 2))
    assert together.mean() >= 0.9 and np.bincount(leaves.ravel()).max() < 20 * leaves.size / 4_096


def test_copies_are_neighbors(spark):
    rows = [(f"a{i}", [1.0, 2.0, 3.0, 4.0]) for i in range(9)] + [("b", [4.0, -3.0, 2.0, -1.0]), ("c", [4.0, -3.0, 2.0, -1.1])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    got = {}
    for r in neighbors.nearest_neighbors(df, "id", "v", 4, 5, 0.7).collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert sorted(got["a8"]) == ["a0", "a1", "a2", "a3", "a4"] and sorted(got["a0"]) == ["a1", "a2", "a3", "a4", "a5"]
    assert got["b"] == ["c"] and got["c"] == ["b"]
    pairs = neighbors.similar_pairs(df, "id", "v", 4)
    assert pairs.where("a >= b").count() == 0 and pairs.count() == pairs.distinct().count()


def test_no_rows(spark):
    df = spark.createDataFrame([], "id string, v array<float>")
    assert neighbors.nearest_neighbors(df, "id", "v", 4).count() == 0


def test_packing_is_exact():
    r = np.random.default_rng(2)
    for block in (r.integers(-100, 100, (7, 5)).astype(np.float32) / 256, r.normal(size=(7, 5)).astype(np.float32), np.zeros((0, 5), np.float32)):
        assert np.array_equal(neighbors.unpack(neighbors.pack(block), 5), block)


SOUND = "Reads rows twice and keeps the newest entry."


@pytest.mark.parametrize(
    ("doc", "name", "ok"),
    [(SOUND, "f", True), ("/**\n * " + SOUND + "\n * @param x rows to read\n */", "f", True), ("TODO: write documentation for this function", "f", False), ("The TODO list of the parser is rewritten in place.", "f", True), ("Returns:\n    None", "f", False), (":param ctx: the input\n    ctx: rows to read", "f", False), ("Merges the sorted ledgers", "merge_sorted_ledger", False), ("COMPACT PENDING PROMPT OWNER", "compactPendingPromptOwner", False), ("/** @inheritdoc */", "f", False), ("Too short text", "f", False), ('r"""' + SOUND + '"""', "f", True), ("/**   */", "f", False), ("Args:\n    a: one two three four\n    b: five", "f", False), ("Liest die Zeilen rückwärts und bricht ab.", "f", True), ("pylint: disable=unused-argument", "f", False), ("按行读取文件并返回最新条目", "f", True)],
)
def test_trivial_documentation(doc, name, ok):
    d = docpairs.describe(docpairs.clean(doc))
    assert docpairs.says_something(docpairs.INHERIT.sub("", d), name) is ok


def test_doc_in_text():
    assert docpairs.doc_in_text('@dec\ndef f(a: dict = {"x": 1}, b=")"):\n    # note\n    """Doc here."""\n    return 1', "python") == "Doc here."
    assert docpairs.doc_in_text("def f():\n    # only a comment\n    return 1", "python") == ""
    assert docpairs.doc_in_text("// x\n/** Doc. */\n/* not */\nfunction f() {}", "javascript") == "/** Doc. */"
    assert docpairs.doc_in_text("function f() { /** inside */ }", "javascript") == ""
    assert docpairs.doc_in_text("def f(", "python") == "" and docpairs.doc_in_text("", "typescript") == ""


def test_inherited_documentation(spark):
    cols = "chunk_id string, repo_name string, symbol_name string, chunk_type string, language string, parent_class string, text string, docstring string, description int"
    fn = lambda i, cls, doc, name="run": (i, "r", name, "function", "python", cls, None, doc, 0)
    kl = lambda i, name, text, lang="python": (i, "r", name, "class", lang, None, text, None, 0)
    rows = [kl("k1", "Base", "class Base:"), kl("k2", "Mid", "class Mid(pkg.Base):"), kl("k3", "Leaf", "class Leaf(Mid, Other):"), kl("k4", "Js", "class Js extends Base {", "javascript"), kl("k5", "Loop", "class Loop(Loop2):"), kl("k6", "Loop2", "class Loop2(Loop):")]
    rows += [fn("f1", "Base", SOUND), fn("f2", "Mid", "{@inheritDoc}"), fn("f3", "Leaf", None), fn("f4", "Js", ""), fn("f5", "Leaf", "TODO"), fn("f6", "Leaf", None, "other"), fn("f7", "Loop", None), fn("f1", "Base", SOUND), (None, *fn("x", "Base", SOUND)[1:]), fn("f8", None, SOUND)]
    df = spark.createDataFrame(rows, cols)
    got = {(r["chunk_id"], r["origin"]) for r in docpairs.documentation_pairs(df).collect()}
    assert got == {("f1", "own"), ("f8", "own"), ("f2", "inherited"), ("f3", "inherited"), ("f4", "inherited")}
    assert docpairs.documentation_pairs(df.limit(0)).count() == 0
    assert docpairs.documentation_pairs(df).select(F.countDistinct("chunk_id")).first()[0] == 5


def test_documentation_from_far_up(spark):
    cols = "chunk_id string, repo_name string, symbol_name string, chunk_type string, language string, parent_class string, text string, docstring string"
    rows = [(f"k{i}", "r", f"C{i}", "class", "python", None, f"class C{i}(C{i + 1}):", None) for i in range(12)] + [(f"c{i}", "r", f"D{i}", "class", "python", None, f"class D{i}(D{(i + 1) % 10}):", None) for i in range(10)]
    rows += [("top", "r", "run", "function", "python", "C12", None, SOUND), ("low", "r", "run", "function", "python", "C0", None, None), ("round", "r", "run", "function", "python", "D0", None, None)]
    got = {(r["chunk_id"], r["origin"]) for r in docpairs.documentation_pairs(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("top", "own"), ("low", "inherited")}


def test_bases_are_found_by_file_and_import(spark):
    cols = "chunk_id string, repo_name string, file_path string, symbol_name string, chunk_type string, language string, parent_class string, text string, docstring string, imports_raw array<string>"

    def klass(file, name, bases):
        return (f"{file}:{name}", "r", file, name, "class", "python", None, f"class {name}({bases}):" if bases else f"class {name}:", None, [])

    def method(file, name, doc):
        return (f"{file}:{name}.run", "r", file, "run", "function", "python", name, "def run(self):\n    pass", doc, [])

    rows = [klass("a.py", "Base", ""), method("a.py", "Base", "Reads the rows of one ledger."), klass("a.py", "Leaf", "Base"), method("a.py", "Leaf", None)]
    rows += [klass("b.py", "Leaf", ""), method("b.py", "Leaf", None)]  # no base: another Leaf's is none of its own
    rows += [klass("pkg/c.py", "Base", ""), method("pkg/c.py", "Base", "Writes the rows of one ledger.")]
    rows += [klass("d.py", "Node", "Base"), method("d.py", "Node", None), ("d.py:module", "r", "d.py", "module", "module", "python", None, "", None, ["from pkg.c import Base"])]
    rows += [klass("e.py", "Edge", "Base"), method("e.py", "Edge", None)]  # nothing tells which Base
    rows += [klass("f.py", "Last", "x.Only"), method("f.py", "Last", None), klass("g.py", "Only", "c.Base"), method("g.py", "Only", None), ("g.py:module", "r", "g.py", "module", "module", "python", None, "", None, ["import pkg.c as c", None])]
    got = {(r["chunk_id"], r["description"][:6]) for r in docpairs.documentation_pairs(spark.createDataFrame(rows, cols)).where("origin = 'inherited'").collect()}
    assert got == {("a.py:Leaf.run", "Reads "), ("d.py:Node.run", "Writes"), ("g.py:Only.run", "Writes"), ("f.py:Last.run", "Writes")}
