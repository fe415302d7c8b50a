import glob
import os
import random
import re
import sys
import sysconfig

import pytest

from ferrule.llm import ecma, provenance, pysource, syntax

GOOD_JS = """
import a, { b as c } from './x';
export const f = async ({ p, q = 1, ...rest }, [s]) => { await g`x ${p ? '}' : q}`; };
class A extends B { static #n = 1; get v() { return this.#n; } async *it() { yield* x; } ['k' + 1]() {} }
label: for (const [k, v] of Object.entries(o)) { if (k) continue label; else break; }
const r = /[/\\]]+/g.test(s) ? x?.y?.[0] ?? z : a / b / c;
for (let i = 0, n = 2; i < n; i++) ;
do { x++ } while (x < 3)
switch (x) { case 1: case 2: break; default: y() }
try { throw new Error('x') } catch { } finally { }
var o = { a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, async f() {}, ...g };
a = b
++c
export default function () {}
"""
GOOD_TS = """
interface P<T extends object = {}> extends Q { readonly a?: string; [k: string]: any; m(x: number): void; new (x: T): P<T> }
type U = 'a' | `b${string}` | (string | number)[] | { [K in keyof T]?: T[K] } | ((x: number) => x is string);
abstract class C<T> implements P<T> { constructor(private readonly x: Map<string, Array<number>>, public y?: T) { super(); } protected abstract z(): Promise<void>; declare n: number; static s!: string; }
enum E { A = 1, B = A << 2 }
declare module 'm' { export const v: number; }
const g = <T,>(x: T): x is T => x as unknown as T;
let v = f<string>(x!)!.y satisfies Z;
function over(a: string): void;
function over(a: any) { return a < b && c > d; }
export type { A } from './a';
import type { B } from './b';
namespace N.M { export let q = 1; }
"""


@pytest.mark.parametrize(("src", "types"), [(GOOD_JS, False), (GOOD_JS, True), (GOOD_TS, True), ("", False), ("#!/usr/bin/env node\nlet x = 1", False), ("'use strict'\n", False)])
def test_valid_scripts(src, types):
    assert ecma.check(src, types) == ""


@pytest.mark.parametrize("src", ["let x = ;", "f(", "a b", "function (x) {}", "if x { }", "<<<<<<< HEAD", "@@ -1 +1 @@", "let s = 'abc", "`${x", "return 1", "x = [1, 2;", "class { m( }", "interface A { x: number }", "const f = (a: any) => a;", "{\n  \"a\": 3,\n  \"b\": 1\n}", "mode = \u2018x\u2019;", "/* open", "const x;", "for (const a of b {}", "import x", "def f():\n  pass", "1 = x", "a => {} ()"])
def test_invalid_scripts(src):
    assert ecma.check(src, False) != ""


@pytest.mark.parametrize(("src", "bad"), [("x = 1\n", False), ("def f(a, /, *, b=1) -> int:\n    return a\n", False), ("match x:\n    case [1, *y] if y: pass\n    case _: pass\n", False), ("match = {'case': 1}\nprint(match)\n", False), ("async def f():\n    async with a as b, c: await d\n", False), ("x = f'{a!r:>{w}}' \"b\"\n", False), ("type X[T] = list[T]\n", False), ("print \"x\"\n", True), ("def f(:\n", True), ("if x\n    y\n", True), ("x = (1\n", True), ("x = 'a\n", True), ("else:\n    x\n", True), ("  x = 1\n", True), ("def f():\npass\n", True), ("x = \u2018a\u2019\n", True), ("<<<<<<< HEAD\n", True), ("try:\n    x\ny\n", True)])
def test_python(src, bad):
    fault, pairs, _ = syntax.lexed_rows("python", src)
    allowed = set(syntax.permitted_rows())
    odd = [p for p in pairs if ("python", *p) not in allowed]
    suspect = bool(fault or odd) or src.count("(") != src.count(")")
    assert syntax.confirmed("python", src) is bad
    assert suspect is bad, (fault, odd)


@pytest.mark.parametrize("src", ["if x = 5:\n    pass\n", 'raise E, "m"\n', "try:\n    x\nexcept E, e:\n    pass\n", "f(a=1, b)\n", "def f(a=1, b):\n    pass\n", "break\n", "f() = 1\n", "def f(a, a):\n    pass\n", "def f():\n    x = 1\n    global x\n", "x = f'{a b}'\n"])
def test_python_faults_within_statements(src):
    assert syntax.lexed_rows("python", src)[0]


def test_files_with_one_fault_are_found(spark):
    rows = [(1, "python", 'def f():\n    raise E, "m"\n'), (2, "python", "def f():\n    raise E('m')\n"), (3, "python", "f(a=1, b)\n"), (4, "python", "while x:\n    break\n")]
    assert {r["file_id"] for r in syntax.invalid_files(spark.createDataFrame(rows, "file_id long, language string, content string")).collect()} == {1, 3}


def test_grammar_permits_real_code():
    allowed = set(syntax.permitted_rows())
    for lang, src in (("javascript", GOOD_JS), ("typescript", GOOD_TS)):
        _, pairs, _ = syntax.lexed_rows(lang, src)
        assert not [p for p in pairs if ("ecma", *p) not in allowed]


@pytest.mark.parametrize("src", ["`${" * 20_000, "(" * 20_000, "[" * 20_000 + "]" * 20_000, "a ? " * 20_000, "x" * 1_000_000])
def test_deep_and_long_texts_do_not_crash(src):
    for lang in ("javascript", "typescript", "python"):
        syntax.lexed_rows(lang, src)
        syntax.confirmed(lang, src)


def test_invalid_files(spark):
    rows = [(1, "r", "python", "x = (1\n", 0), (2, "r", "python", "x = 1\n", 0), (3, "r", "javascript", "let x = [1, 2;", 0), (4, "r", "typescript", GOOD_TS, 0), (5, "r", "unknown", "((", 0), (6, "r", "python", None, 0), (7, "s", "python", "", 0), (None, "r", "python", "(", 0), (1, "r", "python", "x = (1\n", 0), (8, "s", "javascript", "f(a, b]", 0), (9, "s", "python", "x = 1\n" * 20_000, 0)]
    df = spark.createDataFrame(rows, "file_id long, repo_name string, language string, content string, reason int")
    found = syntax.invalid_files(df)
    assert {r["file_id"] for r in found.collect()} == {1, 3, 8}
    rates = {(r["repo_name"], r["language"]): (r["files"], r["invalid"]) for r in syntax.invalid_rates(df, found).collect()}
    assert rates == {("r", "python"): (3, 1), ("r", "javascript"): (1, 1), ("r", "typescript"): (1, 0), ("s", "python"): (2, 0), ("s", "javascript"): (1, 1)}
    assert syntax.invalid_files(df.limit(0)).count() == 0


def test_deep_and_unbalanced_files_are_found(spark):
    rows = [(1, "javascript", "x = " + "[" * 20_000), (2, "javascript", "x = " + "[" * 20_000 + "]" * 20_000), (3, "typescript", "f" + "(" * 20_000 + ")" * 19_999)]
    got = {r["file_id"]: r["reason"] for r in syntax.invalid_files(spark.createDataFrame(rows, "file_id long, language string, content string")).collect()}
    assert got == {1: "nesting", 3: "nesting"}


def test_late_marks_of_head_comments():
    text = "".join(f"# line {i} of the licence\n" for i in range(200)) + "# Code generated by protoc. DO NOT EDIT.\n\nx = 1\n# after the code\n"
    head = provenance.head_comment(text)
    assert provenance.TOOL_MARK.search(head) and "after the code" not in head


HAND = "import os\n\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\n\ndef save(path, text):\n    if not text:\n        raise ValueError(path)\n    for line in text:\n        print(line, os.sep)\n"


def test_provenance(spark):
    blob = "DATA = \"" + "Qx7" * 400 + "\"\n"
    small = "".join(f"x{i}=lambda e,t:e[{i}]if t else{{'a':e}};" for i in range(60))
    gen = "# Code generated by protogen. DO NOT EDIT.\n" + HAND
    rows = [(1, "r", "src/a.py", HAND), (2, "r", "src/b.py", HAND), (3, "r", "vendor/lib/x/c.py", HAND), (4, "r", "src/d.py", blob), (5, "r", "src/e.py", small), (6, "r", "src/f.py", gen), (7, "r", "vendor_portal/g.py", HAND), (8, "r", "src/banner.py", 'BANNER = "# Code generated by {tool}. DO NOT EDIT."\n' + HAND), (9, None, None, None), (10, "r", "h.py", ""), (1, "r", "src/a.py", HAND), (None, "r", "x.py", HAND), (11, "r", "lib/u.py", "# foo - version 1.2.3\n# imported unchanged from upstream.\n" + HAND)]
    df = spark.createDataFrame(rows, "file_id long, repo_name string, path string, content string")
    got = {r["file_id"]: r["label"] for r in provenance.label_files(df.withColumn("label", df.path)).collect()}
    assert got == {1: "handwritten", 2: "handwritten", 3: "vendored", 4: "blob", 5: "minified", 6: "generated", 7: "handwritten", 8: "handwritten", 9: "handwritten", 10: "handwritten", 11: "vendored"}
    assert provenance.label_files(df.limit(0)).count() == 0


def test_propagation_is_exact(spark):
    """Marginals of the two passes against summing over all labels of a small tree."""
    import itertools

    import numpy as np

    rows = [(1, "r", "d/a.py", HAND), (2, "r", "d/e/b_pb2.py", HAND), (3, "r", "c.py", "# Copyright 2020 The X Authors\n" + HAND)]
    df = spark.createDataFrame(rows, "file_id long, repo_name string, path string, content string")
    got = {r["file_id"]: (r["label"], r["confidence"]) for r in provenance.label_files(df).collect()}
    ev = {i: np.array(provenance.evidence(p, t)) for i, _, p, t in rows}
    dirs = {"": np.array(provenance.dir_evidence("")), "d": np.array(provenance.dir_evidence("d")), "d/e": np.array(provenance.dir_evidence("e"))}
    fd, dd = np.array(provenance.FILE_IN_DIR), np.array(provenance.DIR_IN_DIR)
    marg = {i: np.zeros(5) for i in ev}
    for root, d, e, a, b, c in itertools.product(range(5), repeat=6):
        p = np.exp(dirs[""][root] + dirs["d"][d] + dirs["d/e"][e] + dd[d, root] + dd[e, d] + ev[1][a] + fd[a, d] + ev[2][b] + fd[b, e] + ev[3][c] + fd[c, root])
        for i, y in ((1, a), (2, b), (3, c)):
            marg[i][y] += p
    for i, m in marg.items():
        assert got[i][0] == provenance.LABELS[int(m.argmax())]
        assert got[i][1] == pytest.approx(m.max() / m.sum(), rel=1e-6)


def test_configuration_takes_part_but_is_not_judged_by_its_shape(spark):
    numbers = "[" + ", ".join(str(i * 37) for i in range(900)) + "]"
    rows = [(1, "r", "src/data.json", numbers, "unknown"), (2, "r", "src/data.js", "var d = " + numbers, "javascript"), (3, "r", "src/a.py", "def f(x):\n    return x\n", "python"), (4, "r", "vendor/lib/b.json", "{}", None)]
    df = spark.createDataFrame(rows, "file_id long, repo_name string, path string, content string, language string")
    got = {r["file_id"]: r["label"] for r in provenance.label_files(df, language="language").collect()}
    assert got == {1: "handwritten", 2: "blob", 3: "handwritten", 4: "vendored"}


# What the compiler of Python rejects and accepts, a line a case.
PYTHON_BAD = ["1 = x","[x for x in (y := z)]","[[(j := 0) for i in x] for j in y]","def f():\n [x for y in z]\n global z","class A: [x := 1 for y in z]","def f():\n return [(yield) for x in y]","try:\n pass\nexcept* E:\n return","def f():\n try:\n  pass\n except* E:\n  return","for x in y:\n try:\n  pass\n except* E:\n  break","{a: b, **c for a in b}","{*a for a in b}","[*a for a in b]","(x, y for y in z)","[x, y for y in z]","f(x, y for y in z)","f() = 1","f(a=1, 2)","x = {1:2, 3}","def f(a=1,b): pass","x += y += 1","x = 0777","break","yield 1","import a.b as c.d","try:\n  pass\nexcept:\n  pass\nexcept ValueError:\n  pass","def f(a,a): pass","if x = 5:\n pass","raise E, 'm'","try:\n pass\nexcept E, e:\n pass","print 'x'","x = *a","*a = b","(*a)","del f()","f(**k, *a)","f(x for x in y, 1)","x = 1 if 2","for 1 in x: pass","with a as 1: pass","lambda *: 1","def f(*): pass","def f(**k, a): pass","return 1","class A:\n return 1","await x","async def f():\n yield from x","nonlocal x","def f():\n nonlocal x","def f():\n x=1\n global x","'a' b'c'","'\\x1'","b'é'","f'{'","f'{a b}'","f'{a!z}'","x := 1","[x := 1 for x in y]","a not b","not","x = yield","from a import b,","from a import (b","from __future__ import nothing","x=1\nfrom __future__ import annotations","def f():\n from a import *","match x:\n case a: pass\n case b: pass","a.b: int: 3","{**a for a in b}","f(a=1,a=2)","None = 1","def None(): pass","x = (1,2","1abc","0b12","1__0","async with a: pass","[i async for i in x]","a if b else","lambda x=1, y: 2","@","@a\nx=1","else: pass","elif a: pass","try: pass","while True print(1)","x = 5 5","def f(a, /, b, /): pass","def f(*, **k): pass","global x, x.y","assert","del","import","from . import","a..b","a[","x[1:2:3:4]","{1:}","{:1}","()=","f(a.b=1)","f(True=1)","a = b = 1 = c","(a, b) += 1","[a] : int = 1","with (a as b, c as d: pass","class A(x for x in y): pass","type X","async x","f(*)","f(**)","x = not","if True:\nx=1"]
PYTHON_GOOD = ["x=1","*a, = b","*a, b = c","x = *a,","print(*a, **k)","f(a=1, *b)","f(x for x in y)","with (a, b): pass","with (a as b, c as d,): pass","with (a): pass","with (a, b) as c: pass","(x): int = 1","x[*a]","match = 1","match(x)","match[x] = 1","match x:\n case [1, *_]: pass\n case {'a': b, **c}: pass\n case A(1, b=2) | 3: pass\n case _: pass","type X = int","type X[T] = list[T]","def f[T: int, *Ts, **P](a): pass","class A[T](B): pass","f'{a!r:>{w}}'","f'{x=}'","f'{a,}'","async def f():\n async with a as b, c: pass\n return [x async for x in y]","lambda: (yield)","def f():\n return [x for x in (yield)]","[[[[[[[[[[[[x for a in b] for a in b] for a in b] for a in b] for a in b] for a in b] for a in b] for a in b] for a in b] for a in b] for a in b] for a in b]","def f():\n [x for y in z]\n global x","lambda *a, b=1, **k: 0","def f(a, /, b=1, *, c, d=2, **e): pass","if (n := 1): pass","[y := f(x), y**2]","x = yield_","def f():\n x = yield\n yield a, b\n y = yield from z","print >>f, 'x'","a = b = c","a: int","not not a","- - -a","a ** -b ** c","x if y else z if w else v","lambda x: lambda y: x","for x, in y: pass","for x.a, y[0] in z: pass\nelse: pass","del a, b[0], (c, d), [e]","try:\n pass\nexcept* E as e:\n pass","global x\nx = 1","def f():\n x = 1\n def g():\n  nonlocal x\n  x = 2","from a import (b as c, d,)","from .. import x","from ... import x","@a.b(c)[0]\nclass X: pass","x = {**a, 'b': 1}","{*a, 1}","{x: y for x, y in z if a if b}","[(a, b) for a in x for b in y]","'''a\nb'''","u'a' r'\\d' ","1_000 + 0x_ff + 1e5j","...","return_ = 1","if a: b; c;","class A: x = 1; y = 2","print(a if b else c, *d)","x = a if b else lambda: c","assert x, y","raise A from b","async def f():\n await a\n x = await b + await c","f(a)(b)[c].d","case = 1\ntype = 2","a = (yield_)","with open(a) as f, open(b) as g: pass","a[b, c:d, ...]","a[b:=1]","while a: break\nelse: pass","{}","[]","()","(a,)","f'{a:{b}}' 'c'","x: 'a' = yield_","match x, y:\n case a, b: pass","match x:\n case -1 | 1+2j | 'a' 'b' | None: pass","match x:\n case a.b | c.d(): pass","f(a, *b, c)","f(**a, b=1)","def f(*a: *b): pass","try:\n pass\nfinally:\n pass",""]


def python_fault(text):
    tokens, fault = pysource.read(text)
    return fault or pysource.fault_of(tokens)


def compiles(text):
    try:
        compile(text, "file", "exec", dont_inherit=True)
    except (SyntaxError, ValueError):
        return False
    return True


@pytest.mark.filterwarnings("ignore")
def test_python_productions_decide_as_the_compiler():
    assert [x for x in PYTHON_BAD if compiles(x) or not python_fault(x)] == []
    assert [x for x in PYTHON_GOOD if not compiles(x) or python_fault(x)] == []


@pytest.mark.filterwarnings("ignore")
def test_python_productions_on_changed_sources():
    """Statements of the standard library, whole and with a token dropped, doubled, moved or replaced."""
    r, files = random.Random(4), sorted(glob.glob(os.path.join(sysconfig.get_paths()["stdlib"], "*.py")))
    words = "( ) [ ] { } : , . = == * ** if else for in not lambda x 1 's' return yield await async def class break import as from with try except pass del global is @ -> := += None match case".split()
    tried = 0
    for path in r.sample(files, 60):
        text = open(path, encoding="utf-8").read()
        assert not python_fault(text), path
        lines = text.split("\n")
        starts = [i for i, x in enumerate(lines) if x[:1].isalpha() or x[:1] == "@"] + [len(lines)]
        for _ in range(25):
            k = r.randrange(len(starts) - 1)
            part = "\n".join(lines[starts[k] : starts[min(len(starts) - 1, k + r.randrange(1, 5))]])
            tokens = list(re.finditer(r"\w+|[^\w\s]|\n[ \t]*", part))
            if not tokens or len(part) > 6000:
                continue
            m, put = r.choice(tokens), r.choice(["", r.choice(words), r.choice(tokens)[0], " " + r.choice(words) + " "])
            changed = part[: m.start()] + put + part[m.end() :]
            tried += 1
            assert bool(python_fault(changed)) != compiles(changed), changed
    assert tried > 500


@pytest.mark.parametrize("depth", [500, 4000])
def test_deep_scripts_are_judged(depth):
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(syntax.FRAMES)
    try:
        for inner, bad in (("", False), ("var x = ;", True)):
            assert bool(syntax.lexed_rows("javascript", "f(function(){" * depth + inner + "})" * depth)[0]) is bad
        for inner, bad in (("1", False), ("1 2", True)):
            assert bool(syntax.lexed_rows("typescript", "[" * depth + inner + "]" * depth)[0]) is bad
    finally:
        sys.setrecursionlimit(limit)
