from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.operators import chunking, parsing
from ferrule.plans import catalog, registry


def sentences(text, target=150):
    out, cur = [], ""
    for s in text.replace("\n", " ").split(". "):
        if len(s + cur) < target:
            cur += s + ". "
        else:
            if cur:
                out.append(cur.strip(" "))
            cur = s + ". "
    return out + ([cur.strip(" ")] if cur else [])


def separated(text, size=200, overlap=20):
    chunks = None
    if len(text) <= size:
        chunks = [text] if text else []
    else:
        for sep in ("\n\n", "\n", ". ", " "):
            if sep in text:
                chunks, cur = [], ""
                for p in text.split(sep):
                    if len(cur + sep + p) <= size:
                        cur += sep + p if cur else p
                    else:
                        chunks += [cur] if cur else []
                        cur = p
                chunks += [cur] if cur else []
                break
        else:
            chunks = [text[i : i + size] for i in range(0, len(text), size)]
    return [(chunks[i - 1][-overlap:] + " " + c) if i else c for i, c in enumerate(chunks)]


TEXTS = ["", "a", "One. Two. Three", "x" * 450, "word " * 120, "Long sentence here. " * 30, "p1\n\n" + "q" * 300 + "\n\nr", "a\nb\n" * 90, ". ", "Ünï. " * 60, "\n\n\n"]


def test_text_splitters(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    rows = df.select("i", chunking.fixed_chunks(F.col("t"), 100).alias("f"), chunking.sentence_chunks(F.col("t")).alias("s"), chunking.separator_chunks(F.col("t")).alias("r"), chunking.paragraphs(F.col("t")).alias("p")).orderBy("i").collect()
    for t, row in zip(TEXTS, rows, strict=False):
        assert row["f"] == [t[i : i + 100] for i in range(0, len(t), 100)]
        assert row["s"] == sentences(t), t
        assert row["r"] == separated(t), t
        assert row["p"] == [x.strip() for x in t.split("\n\n") if x.strip()]
    assert rows[-1]["f"] == [] and rows[-1]["s"] == [] and rows[-1]["r"] == [] and not rows[-1]["p"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab. \n", max_size=400), min_size=1, max_size=5))
def test_splitters_by_property(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", chunking.sentence_chunks(F.col("t")).alias("s"), chunking.separator_chunks(F.col("t")).alias("r"), chunking.fixed_chunks(F.col("t"), 7).alias("f")).collect():
        t = texts[r["i"]]
        assert r["s"] == sentences(t) and r["r"] == separated(t) and "".join(r["f"]) == t


def test_windows_cover_the_text(spark):
    want = {1: [(0, 1)], 2700: [(0, 2700)], 2701: [(0, 2701), (2700, 2701)], 3000: [(0, 3000), (2700, 3000)], 5401: [(0, 3000), (2700, 5401), (5400, 5401)]}
    df = spark.createDataFrame([("r", f"{n}.txt", "".join(chr(97 + i % 26) if i % 10 else "\n" for i in range(n))) for n in want] + [("r", "none", None), ("r", "empty", "")], "repo_name string, path string, content string")
    got = {}
    for r in chunking.overlap_windows(df).collect():
        got.setdefault(int(r["file_path"][:-4]), []).append((r["start_char"], r["start_char"] + len(r["text"])))
        assert r["end_line"] - r["start_line"] == r["text"].count("\n")
    assert {k: sorted(v) for k, v in got.items()} == want


def test_parse_files(spark):
    py = 'import os\n@d\ndef f(x, y):\n    """Doc."""\n    g(len(x)); os.path.join(x)\nclass A(B):\n    def m(self):\n        return self.n()\nif 1:\n    def hidden(): pass\n'
    js = "import x from './y';\n/** Doc. */\nfunction f(a) { return g(a) + '}'; }\nclass K extends L {\n  m(x) { if (x) { h(x); } }\n}\nconst arrow = () => 1;\n"
    rows = [("r", "a.py", py, "python"), ("r", "a.js", js, "javascript"), ("r", "bad.py", "def (", "python"), ("r", "n", None, "python"), ("r", "b", "  ", "python"), ("r", "u", "x", "unknown"), ("r", "a.py", py, "python")]
    df = spark.createDataFrame(rows, "repo_name string, path string, content string, language string")
    got = parsing.parse_files(df).collect()
    sound = {(r["file_path"], r["parent_class"], r["symbol_name"]): r for r in got if r["error"] is None}
    assert set(sound) == {("a.py", None, "f"), ("a.py", None, "A"), ("a.py", "A", "m"), ("a.js", None, "f"), ("a.js", None, "K"), ("a.js", "K", "m")}
    f = sound["a.py", None, "f"]
    assert f["calls_out_raw"] == ["g", "os"] and f["docstring"] == '"""Doc."""' and f["start_line"] == 2 and f["imports_raw"] == ["import os"]
    assert sound["a.js", "K", "m"]["calls_out_raw"] == ["h"] and sound["a.js", None, "f"]["docstring"] == "/** Doc. */"
    assert [r["file_path"] for r in got if r["error"]] == ["bad.py"]
    assert parsing.parse_files(df.limit(0)).count() == 0


def test_files_without_a_parser_become_windows(spark):
    text = "a: 1\n" * 800
    rows = [("r", "a.py", "def f():\n    pass\n", "python"), ("r", "bad.py", "def (", "python"), ("r", "c.yaml", text, "unknown"), ("r", "c.yaml", text, "unknown"), ("r", "d.rs", "fn x() {}\n", "rust"), (None, "e", "e", None), ("r", "none", None, "unknown"), ("r", "empty", "", "unknown")]
    df = spark.createDataFrame(rows, "repo_name string, path string, content string, language string")
    out = parsing.chunk_files(df)
    assert out.columns == parsing.parse_files(df).columns
    got = out.collect()
    assert [r["file_path"] for r in got if r["error"]] == ["bad.py"]
    windows = {(r["file_path"], r["symbol_name"]): r for r in got if r["chunk_type"] == "module"}
    assert set(windows) == {("c.yaml", "chunk_0"), ("c.yaml", "chunk_1"), ("d.rs", "chunk_0"), ("e", "chunk_0")} and len(got) == 6
    w = windows["c.yaml", "chunk_1"]
    assert w["text"] == text[2700:] and (w["start_line"], w["end_line"]) == (541, 801) and w["chunk_id"] == parsing.make_id("r", "c.yaml", None, "chunk_1", "2700")
    assert w["calls_out_raw"] == [] and w["imports_raw"] == [] and windows["e", "chunk_0"]["language"] == "unknown" and windows["e", "chunk_0"]["chunk_id"]
    assert windows["d.rs", "chunk_0"]["language"] == "rust"


def test_parse_chunks_reads_every_file(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have no such file
    names = lambda df, c: {(r["repo_name"], r[c]) for r in df.select("repo_name", c).distinct().collect()}
    files = registry.files(spark, sf).where("language is null or language not in ('python', 'javascript', 'typescript')").where("length(content) > 0")
    assert files.count() > 0 and names(files, "path") <= names(catalog.queries()["parse_chunks"](spark, sf), "file_path")
