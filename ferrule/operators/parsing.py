"""Source files into function, class and window chunks with raw call edges.

Python is parsed with the standard library, JavaScript and TypeScript with a scanner of
declarations. A file that cannot be parsed gives one row with its error and no chunk.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.chunking import overlap_windows
from ferrule.operators.graph import JAVASCRIPT_BUILTINS, PYTHON_BUILTINS

SCHEMA = "repo_name string, chunk_id string, symbol_name string, chunk_type string, language string, parent_class string, file_path string, start_line long, end_line long, text string, docstring string, calls_out_raw array<string>, imports_raw array<string>, error string"


def make_id(repo: str, path: str, owner: str | None, symbol: str, signature: str) -> str:
    """The id that ``functions.names.chunk_id`` gives as a column."""
    dotted = path.replace("/", ".").replace("\\", ".")
    return f"{repo}::{dotted}::{owner or 'module'}.{symbol}::{hashlib.sha256(signature.encode()).hexdigest()[:8]}"


def _row(repo, path, lang, kind, owner, symbol, signature, start, end, text, doc, calls, imports) -> tuple:
    return (repo, make_id(repo, path, owner, symbol, signature), symbol, kind, lang, owner, path, start, end, text, doc, calls, imports, None)


def first_segments(callees: Iterator[str], builtins: list[str]) -> list[str]:
    return sorted({c.split(".", 1)[0] for c in callees if c} - set(builtins))


def parse_python(repo: str, path: str, src: str) -> list[tuple]:
    """Top-level and class-body functions and class headers; functions within functions or branches are not emitted."""
    tree, lines, out = ast.parse(src), src.splitlines(keepends=True), []
    imports = sorted({ast.get_source_segment(src, n) or "" for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)})

    def cut(a: int, b: int) -> str:
        return "".join(lines[a - 1 : b]).rstrip("\n")

    def doc_of(node) -> str | None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            return ast.get_source_segment(src, first.value)
        return None

    def walk(body: list, owner: str | None) -> None:
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                calls = first_segments((ast.unparse(c.func) for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)), PYTHON_BUILTINS)
                signature = f"({ast.unparse(n.args)})"
                out.append(_row(repo, path, "python", "function", owner, n.name, signature, start, n.end_lineno, cut(start, n.end_lineno), doc_of(n), calls, imports))
            elif isinstance(n, ast.ClassDef):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                head_end = n.body[0].lineno if n.body else n.end_lineno
                out.append(_row(repo, path, "python", "class", None, n.name, "", start, head_end, cut(start, max(start, head_end - 1)).strip(), doc_of(n), [], imports))
                walk(n.body, n.name)

    walk(tree.body, None)
    return out


_JS_SKIP = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_JS_FUNCTION = re.compile(r"\b(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^>(]*>)?\(")
_JS_CLASS = re.compile(r"\bclass\s+([\w$]+)[^{;]*\{")
_JS_METHOD = re.compile(r"(?:^|[;{}])\s*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^>(]*>)?\(")
_JS_IMPORT = re.compile(r"\bfrom\s*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)|^\s*import\s*['\"]([^'\"]+)['\"]", re.M)
_JS_CALL = re.compile(r"(?<![\w$.])((?:[\w$]+\??\.)*[\w$]+)\s*\(")
_JS_WORDS = set("if for while switch catch function return typeof new await super constructor do else import".split())


def _blanked(src: str) -> str:
    """The source with comments and string contents as blanks, at the same places."""
    return _JS_SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), src)


def _closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``, or the end."""
    pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
    for i in range(at, len(text)):
        if text[i] in pairs:
            depth += 1
        elif text[i] in pairs.values():
            depth -= 1
            if depth == 0:
                return i + 1
    return len(text)


def parse_script(repo: str, path: str, src: str, lang: str) -> list[tuple]:
    """Function declarations, generator functions, classes and their methods; arrow functions are not emitted."""
    flat, out = _blanked(src), []
    imports = sorted({a or b or c for a, b, c in _JS_IMPORT.findall(src)})

    def line(at: int) -> int:
        return src.count("\n", 0, at) + 1

    def doc_before(at: int) -> str | None:
        m = re.search(r"(/\*\*(?:(?!\*/)[\s\S])*\*/)\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?$", src[:at])
        return m[1] if m else None

    def emit(owner: str | None, name: str, start: int, opening: int) -> int:
        after = _closing(flat, opening)
        body = flat.find("{", after)
        stop = re.compile(r"[;}]").search(flat, after)
        if body < 0 or stop and stop.start() < body and flat[stop.start()] == ";":
            return after
        end = _closing(flat, body)
        calls = first_segments((c.replace("?", "") for c in _JS_CALL.findall(flat[body:end]) if c.split(".")[0] not in _JS_WORDS), JAVASCRIPT_BUILTINS)
        out.append(_row(repo, path, lang, "function", owner, name, src[opening:after], line(start), line(end - 1), src[start:end], doc_before(start), calls, imports))
        return end

    taken: list[tuple[int, int]] = []
    for m in _JS_CLASS.finditer(flat):
        end = _closing(flat, m.end() - 1)
        taken.append((m.start(), end))
        out.append(_row(repo, path, lang, "class", None, m[1], "", line(m.start()), line(m.end() - 1), src[m.start() : m.end() - 1].strip(), doc_before(m.start()), [], imports))
        at = m.end() - 1
        while found := _JS_METHOD.search(flat, at, end):
            opening = found.end() - 1
            if found[1] in _JS_WORDS - {"constructor"}:
                at = _closing(flat, opening)
                continue
            at = emit(m[1], found[1], found.start(1), opening)
    for m in _JS_FUNCTION.finditer(flat):
        if not any(a <= m.start() < b for a, b in taken):
            emit(None, m[1], m.start(), m.end() - 1)
    return out


#: The parser of each language; more can be added.
PARSERS: dict[str, Callable[[str, str, str], list[tuple]]] = {
    "python": parse_python,
    "javascript": lambda r, p, s: parse_script(r, p, s, "javascript"),
    "typescript": lambda r, p, s: parse_script(r, p, s, "typescript"),
}


def parse_files(files: DataFrame) -> DataFrame:
    """Chunks of ``files`` (``repo_name, path, content, language``), and one ``error`` row per file that fails.

    Files of languages without a parser, and null or blank contents, give nothing;
    repeated files count once per path.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in it:
            rows = []
            for repo, path, content, lang in pdf.itertuples(index=False):
                try:
                    rows += PARSERS[lang](repo or "", path or "", content)
                except Exception as e:  # a bad file must not end the job
                    rows.append((repo, None, None, None, lang, None, path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=names)

    src = files.where(F.col("language").isin(*PARSERS) & (F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", "") != ""))
    return src.select("repo_name", "path", "content", "language").dropDuplicates(["repo_name", "path"]).mapInPandas(run, SCHEMA)


def chunk_files(files: DataFrame, size: int = 3000, stride: int = 2700) -> DataFrame:
    """``parse_files``, and the overlapping windows of the files of all other languages.

    Windows are chunks of type ``module`` without calls and imports, so no edge starts
    there; a null language becomes ``unknown``. Only empty and null contents have none;
    repeated files count once per path.
    """
    rest = files.where(F.col("language").isNull() | ~F.col("language").isin(*PARSERS))
    rest = rest.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("repo_name", "path")), "content", F.coalesce("language", F.lit("unknown")).alias("language"))
    w = overlap_windows(rest.where(F.length("content") > 0).dropDuplicates(["repo_name", "path"]), size, stride, ("language",))
    given = {"chunk_type": F.lit("module"), "calls_out_raw": F.array(), "imports_raw": F.array()}
    columns = [c.split() for c in SCHEMA.split(", ")]
    return parse_files(files).unionByName(w.select(*(given.get(c, F.col(c) if c in w.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns)))
