import glob
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.llm import leakage, packing, queries, sentences


def split(text):
    out, p = [], 0
    for e in sentences.unit_ends(text):
        out.append(text[p:e].strip())
        p = e
    return out


@pytest.mark.parametrize(
    ("text", "units"),
    [("Mr. Bell of the U.S. team left at 3 p.m. today. He ran.", ["Mr. Bell of the U.S. team left at 3 p.m. today.", "He ran."]), ('The log said "not found. Giving up." and stopped. "Is it?" was asked.', ['The log said "not found. Giving up." and stopped.', '"Is it?" was asked.']), ("It costs 3.5 MB, e.g. at night. load_rows() fails.", ["It costs 3.5 MB, e.g. at night.", "load_rows() fails."]), ("Der Bericht liest z. B. die Datei. Am 3. Mai kam er.", ["Der Bericht liest z. B. die Datei.", "Am 3. Mai kam er."]), ("M. Untel a demandé : « Où est-il ? » La version 9.7 suit.", ["M. Untel a demandé : « Où est-il ? »", "La version 9.7 suit."]), ("¡No llame! ¿Por qué?", ["¡No llame!", "¿Por qué?"]), ("他问：“还在吗？”如果没有，就停。日志里写着“放弃。”然后停了……真的吗？！", ["他问：“还在吗？”", "如果没有，就停。", "日志里写着“放弃。”然后停了……", "真的吗？！"]), ("「動いていますか？」と聞かれた。本当ですか？！", ["「動いていますか？」と聞かれた。", "本当ですか？！"]), ("डॉ. अमुक जाँचते हैं। कैश खाली है?", ["डॉ. अमुक जाँचते हैं।", "कैश खाली है?"]), ("لماذا فارغ؟ د. فلان يراجع.", ["لماذا فارغ؟", "د. فلان يراجع."]), ("ไม่มีใครทราบ ทำไมว่าง", ["ไม่มีใครทราบ", "ทำไมว่าง"]), ("«Где кэш?» — спросил он. Узлы и т. д. в одном месте.", ["«Где кэш?» — спросил он.", "Узлы и т. д. в одном месте."]), ("# Title. With dot\nText one\ncontinues. Two.\n\nThree", ["# Title. With dot", "Text one\ncontinues.", "Two.", "Three"]), ("- One. Two\n- Three\n1. Four\nFive", ["- One.", "Two", "- Three", "1. Four", "Five"]), ("A.\n```py\nx = 1. Y\n\nz\n```\nB.", ["A.", "```py\nx = 1. Y\n\nz\n```", "B."]), ("```\nopen. end", ["```\nopen. end"]), ("", []), ("  \n\n ", []), ("no end", ["no end"]), ("(A second one.) The next.", ["(A second one.)", "The next."]), ("Es kam am\n3. Mai an. Gut.", ["Es kam am\n3. Mai an.", "Gut."]), ("Run `a. B` first. Then go.", ["Run `a. B` first.", "Then go."]), ("One.\u200b Two.", ["One.", "\u200b Two."]), ("Wait... it goes on. Done!  ", ["Wait... it goes on.", "Done!"])],
)
def test_units(text, units):
    assert split(text) == units


@settings(max_examples=150, deadline=None)
@given(st.text("aB .!?\n\"()-#`。1", max_size=120))
def test_units_cover_the_text(text):
    ends = sentences.unit_ends(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) and not text[e - 1].isspace() for e in ends)
    assert (not ends) == (not text.strip())
    if ends:
        assert not text[ends[-1] :].strip()


def test_long_sentences_stay_whole():
    for n in (602, 1202, 6002):
        assert len(split("It said " + "and so on. and " * (n // 4) + "then it ended.")) == 1
    assert len(split("It began. " + "One two three. " * 3000 + "and so. " * 3000)) == 3001


def test_spans_are_the_best(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(sentences, "LONG", 6)
    monkeypatch.setattr(sentences, "LOSS", 0.8)
    for _ in range(40):
        text = "".join(r.choice(["so we go. ", "Then he ran. ", "(One. ", "two.) ", '"Go. ', 'on." ', "one two three four ", "Dr. "]) for _ in range(14)).strip()
        cands = {}
        for m in sentences.TERMINATOR.finditer(text):
            if (v := sentences.boundary(text, m, m.end())) is not None and m.end() < len(text) and text[m.end() :].strip():
                cands[m.end()] = v
        at, deep = [0, *sorted(cands), len(text)], sentences.depths(text)
        best = [0.0]
        for j in range(1, len(at)):
            n = [len(text[at[i] : at[j]].split()) for i in range(j)]
            best.append(cands.get(at[j], 0.0) + max(best[i] - 0.8 * max(0, n[i] - 6) - (0.5 if n[i] < 2 else 0) - 4 * min(2, abs(deep[at[j]] - deep[at[i]])) for i in range(j)))
        got, ends = 0.0, [0, *sentences.split_block(text)]
        for a, b in zip(ends, ends[1:], strict=False):
            n = len(text[a:b].split())
            got += cands.get(b, 0.0) - 0.8 * max(0, n - 6) - (0.5 if n < 2 else 0) - 4 * min(2, abs(deep[a] - deep[b]))
        assert got == pytest.approx(best[-1])


def test_sentence_units(spark):
    rows = [(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (3, "", 0), (None, "X.", 0), (4, "A long one. " * 5000, 0)]
    got = sentences.sentence_units(spark.createDataFrame(rows, "doc_id long, text string, unit int"))
    assert got.where("doc_id = 4").count() == 5000
    assert [(r["unit"], r["start_char"], r["end_char"], r["sentence"]) for r in got.where("doc_id = 1").orderBy("unit").collect()] == [(0, 0, 4, "One."), (1, 5, 9, "Two.")]
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {1, 4}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=25))
def test_sum_of_squares_takes_the_least(sizes):
    where, gaps = packing.sum_of_squares(np.array(sizes), 10)
    left = [10] * (max(where) + 1)
    opened = set()
    for i, (s, c) in enumerate(zip(sizes, where, strict=True)):
        cost = lambda g: sum(sum(1 for k in opened2 if g[k] == v) ** 2 for v in {g[k] for k in opened2} if v > 0)  # noqa: E731, B023
        tries = {}
        for k in [*opened, max(opened, default=-1) + 1]:
            if k >= len(left) or left[k] < s:
                continue
            opened2 = opened | {k}
            tries[k] = cost([x - s if j == k else x for j, x in enumerate(left)])
        assert c in tries and tries[c] == min(tries.values()), (i, tries)
        left[c] -= s
        opened.add(int(c))
    assert list(gaps) == left


@pytest.mark.parametrize("part", [50, 100_000])
def test_pack(spark, part):
    r = random.Random(4)
    rows = [(i, r.choice([0, 1, 100, 700, 2047, 2048, 2049, 5000, r.randint(1, 900)])) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = packing.pack(df, "doc_id", "n", 2048, part_items=part).collect()
    by, load = {}, {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
        if x["container"]:
            load[x["container"]] = load.get(x["container"], 0) + x["size"]
    assert set(by) == {i for i, _ in rows} and max(load.values()) <= 2048
    for i, n in rows:
        p = sorted(by[i], key=lambda x: x["piece"])
        assert sum(x["size"] for x in p) == (n or 0) and len(p) == max(1, -(-(n or 0) // 2048))
        assert all(x["start"] == 2048 * x["piece"] for x in p)
    total = sum(load.values())
    assert len(load) <= 1.04 * total / 2048 + 2
    rep = packing.fill_report(packing.pack(df, "doc_id", "n", 2048, part_items=part), 2048).first()
    assert rep["tokens"] == total and rep["most_used"] <= 2048
    assert packing.pack(df.limit(0), "doc_id", "n", 2048).count() == 0


def test_no_part_outgrows_a_task(spark):
    got = packing.pack(spark.range(3200).withColumn("n", F.lit(1100)), "id", "n", 2048, part_items=100)
    part = got.groupBy(F.regexp_extract("container", r"^(p\d+\.\d+)\.", 1)).count()
    assert got.select("container").distinct().count() == 3200 and part.agg(F.max("count")).first()[0] < 200


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1 and len(got) == 4
    with pytest.raises(Exception, match="negative size"):
        packing.pack(spark.createDataFrame([(1, -1)], "doc_id long, n_tokens long"), "doc_id", "n_tokens", 10).count()


WORDS = [f"{a}{b}" for a in ("sol", "mar", "tin", "rok", "vel", "pas", "gem", "lun") for b in ("an", "or", "ix", "um", "eta", "ik", "osa", "ade")]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    text = lambda n: [r.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(text(60))) for i in range(12)]
    docs = []
    for d in range(60):
        w = text(r.randint(5, 120))
        if d % 3 == 0:
            it, n = items[d % 12][1].split(), r.choice([8, 11, 12, 13, 30])
            s = r.randint(0, 60 - n)
            run = it[s : s + n]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + r.choice(["", ",", " \n//", "\u200b"]) if r.random() < 0.5 else f"**{x}**" for x in run]
        docs.append((d, " ".join(w)))
    return docs, items


def test_cells_find_what_is_close():
    r = np.random.default_rng(1)
    v = np.repeat(r.normal(size=(40, 24)), 20, axis=0) + 0.4 * r.normal(size=(800, 24))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    cells, p = leakage.Cells(v, np.arange(800), 0.2), v[::3]
    want = set(zip(*np.nonzero(p @ v.T >= 0.65), strict=True))
    got = set(zip(*cells.near(p, 0.65), strict=True))
    assert got <= want and len(got) >= 0.98 * len(want)


def test_sums_travel_in_slices(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SLICE_BYTES", 64)
    rows = [leakage.slices(np.full((7, 3), float(i)), i % 3).to_pydict() for i in range(5)]
    df = spark.createDataFrame([x for r in rows for x in zip(*r.values(), strict=True)], "part long, slice long, data binary")
    assert leakage.summed(df).tolist() == [10.0] * 21 and leakage.summed(df.limit(0)) is None


def test_blocks_of_items(spark, corpus, monkeypatch):
    docs, items = corpus
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(df, it).where("kind = 'run'").collect()}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 1500)
    assert len(list(leakage.item_blocks(it.withColumn("answer", F.lit(None).cast("string"))))) > 2
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(df, it).where("kind = 'run'").collect()} == want


def test_leaks_against_brute_force(spark, corpus):
    docs, items = corpus
    want = set()
    for d, t in docs:
        w = leakage.words(t)
        for i, s in items:
            if leakage.longest_run(np.array([hash(x) for x in w]), np.array([hash(x) for x in leakage.words(s)])) >= 12:
                want.add((d, i))
    df = spark.createDataFrame([*docs, docs[0], (900, None), (901, ""), (None, items[0][1]), (902, items[1][1] * 200)], "doc_id long, text string").withColumn("kind", F.lit(1))
    it = spark.createDataFrame([*items, items[0], (None, "x"), (77, None)], "item_id long, text string").withColumn("run", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(df, it).where("kind = 'run'").collect()}
    assert got == want | {(902, 1)}
    assert leakage.leaked_passages(df, it.limit(0)).count() == 0
    assert leakage.leaked_passages(df.limit(0), it).count() == 0


def test_paraphrases(spark):
    a = "the worker reads every record from the shared ledger and writes the newest entry back before the nightly run starts again"
    b = "the worker reads each record of the shared ledger then writes the newest one back before the nightly job starts again"
    far = "nothing in this text has to do with anything that was asked elsewhere in the collection of questions today"
    docs = spark.createDataFrame([(1, b + " yes indeed"), (2, far)], "doc_id long, text string")
    items = spark.createDataFrame([(1, a, "yes indeed"), (2, a, "no such words")], "item_id long, text string, answer string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in leakage.leaked_passages(docs, items, answer="answer", paraphrase=0.7, closeness=0.5).collect()}
    assert got == {(1, 1, "paraphrase")}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert leakage.common_subsequence(np.array(a), np.array(b)) == t[-1][-1]


def test_words():
    assert leakage.words("Él <b>dijo</b>: \u201cco\u200bmo\u201d [aquí](http://x.y/z) **don't** &amp; a_b") == ["el", "dijo", "como", "aqui", "dont", "a", "b"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    ours, theirs = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(map(tuple, ours[sorted(ours)].to_numpy().tolist())) == sorted(map(tuple, theirs[sorted(theirs)].to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.count() >= 0
    fixed = {"p1_found": ["chunk_id_a", "chunk_id_b"], "p2_found": ["chunk_id"], "p4_found": ["qa_id", "defect"], "p5_found": ["file_id"], "p6_found": ["file_id"], "p7_found": ["source_table", "record_key", "line_no"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "end_char"]}
    assert name not in fixed or df.columns == fixed[name]
