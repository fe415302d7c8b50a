"""Functions paired with their documentation (problem 2).

A function's documentation is its ``docstring`` or, where that is blank, the
docstring or ``/** */`` comment in its text. Comment marks, tags and parameter
and return lists are taken off, and what is left must say something. A method
that says nothing itself, or refers to its parent with an inherit tag, takes the
documentation of the nearest class above it that documents a method of that name:
class headers are parsed into child-parent rows, whose bases are found by file and
import statements, and each round joins the methods that are still open with them,
one level up. What stays unresolved is dropped.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import checkpoint

# Texts and openings that hold a place for documentation to come, or switch a tool.
PLACEHOLDERS = re.compile(
    r"^(todo|fixme|xxx|tbd|tba|wip|n/?a|none|null|undefined|undocumented|deprecated|constructor|placeholder|lorem ipsum|\[?_?summary_?\]?( line)?|docstring|description|missing doc\w*|no (description|documentation|docs?|comment)s?|"
    r"noqa|pylint|type: ?ignore|eslint|prettier|ts-|@ts-|istanbul|pragma|flake8|mypy|jshint|jslint|fmt:|isort:|coverage|"
    r"(please )?(add|insert|write|put|fill in|enter|provide|document|describe)\b.*\b(doc\w*|description|comment|summary|me|this|here|text)\b|"
    r"(the )?(doc\w*|description|comment|summary|text|details?)( text)? (goes|go|comes|to come|will follow|follows|to be (added|written|done)|pending|missing|needed|here)|"
    r"(documentation|docs|description) (is )?(to|will) |to be (documented|described|done|written|added|determined)|(auto-?generated|generated) (method|function|constructor|stub|doc)|"
    r"see (above|below|base class|parent|super\w*)\W*$|same as above\W*$|"
    r"your (description|documentation|text|comment|docs?) |some (description|documentation|docs?|text)\W*$|this (function|method|is a (function|method))\W*$)",
    re.I,
)
# Tags whose rest of line and continuation belong to a parameter or return list.
LIST_TAGS = "param parameter arg argument key keyword kwarg kwargs type rtype return returns raise raises except exception throws yield yields template typeparam typedef property prop var ivar cvar vartype attribute this".split()
SECTIONS = re.compile(r"^(args?|arguments|parameters?|params?|other parameters|keyword (args|arguments)|kwargs|returns?|yields?|raises|throws|exceptions|attributes|warns|receives)\s*:?\s*$", re.I)
INHERIT = re.compile(r"\{?@?inherit_?docs?\b\}?", re.I)
ARTICLES = {"a", "an", "the", "of", "to", "this", "and", "for"}
WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+(?:['’][^\W_]+)*")
QUOTED = re.compile(r"^\s*[rRuUbB]{0,2}('''|\"\"\"|'|\")(.*?)(\1)?\s*$", re.S)


def clean(doc: str) -> str:
    """The text of a documentation comment without quotes or comment marks."""
    doc = doc.replace("\r\n", "\n").replace("\r", "\n")
    s = doc.strip()
    if m := QUOTED.match(s):
        s = m[2] if m[3] or len(m[1]) == 3 else s
    if s.startswith("/*"):
        s = re.sub(r"\*+/\s*$", "", re.sub(r"^/\*+!?", "", s))
        s = "\n".join(re.sub(r"^\s*\*+(?= |\t|$|[^\s*])[ \t]?", "", line) for line in s.split("\n"))
    elif re.match(r"(///?|#)", s):
        s = "\n".join(re.sub(r"^\s*(///?|#+)!?\s?", "", line) for line in s.split("\n"))
    return s.strip("\n")


def describe(doc: str) -> str:
    """What a cleaned comment says besides its tags, parameter and return lists."""
    out, drop_until, skipping = [], None, False
    lines = doc.expandtabs(4).split("\n")
    for i, line in enumerate(lines):
        bare, indent = line.strip(), len(line) - len(line.lstrip())
        if skipping:  # inside a list: its deeper lines, in ruled sections also lines of the same depth
            if not bare or indent > drop_until or set(bare) <= set("-=~") or ruled and not SECTIONS.match(bare):
                if bare or not ruled:
                    skipping = skipping and (bool(bare) or section)
                    continue
            skipping = False
        tag = re.match(r"[:@\\](\w+)\b", bare)
        if tag and tag[1].lower() in LIST_TAGS:
            skipping, drop_until, section, ruled = True, indent, False, False
            continue
        if SECTIONS.match(bare):
            after = lines[i + 1].strip() if i + 1 < len(lines) else ""
            ruled = bool(after) and set(after) <= set("-=~")
            if ruled or bare.endswith(":") or i + 1 < len(lines) and len(lines[i + 1]) - len(lines[i + 1].lstrip()) > indent:
                skipping, drop_until, section = True, indent, True
                continue
        if re.match(r"(returns?|args?|params?|raises|yields?)\s*:", bare, re.I):
            continue
        line = re.sub(r"^\s*[@\\]\w+\s*", "", line) if re.match(r"\s*[@\\](?!inherit)\w+", line, re.I) else line
        line = re.sub(r"\{@\w+\s+([^}]*)\}", r"\1", re.sub(r"^\s*:\w+( \w+)?:\s*", "", line))
        out.append(line.strip())
    return "\n".join(out).strip()


def stem(word: str) -> str:
    """A word without common English endings, so that forms of one word agree."""
    w = word.lower().replace("’", "'").removesuffix("'s")
    for end, put in (("ies", "y"), ("ied", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) + len(put) >= 3 and not (end == "s" and w.endswith("ss")):
            w = w[: len(w) - len(end)] + put
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiouls":
        w = w[:-1]
    return w.removesuffix("e") if len(w) > 3 else w


def words_of(name: str) -> set[str]:
    return {stem(x) for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+", name or "")}


def says_something(description: str, name: str) -> bool:
    words = WORD.findall(description)
    if len([w for w in words if not w.isdigit()]) < 4:
        return False
    flat = re.sub(r"\s+", " ", description).strip(" \t*-#.:<>[](){}_!?\"'`")
    if PLACEHOLDERS.match(flat) and len(re.findall(r"[.!?](?=\s|$)|\n\n", description)) < 2 and len(words) <= 14:
        return False
    said = {stem(w) for w in words if w.lower() not in ARTICLES}
    return not said <= words_of(name) | {stem(x) for x in re.findall(r"\w+", (name or "").lower())} and bool(said)


def skip_signature(text: str, i: int) -> int:
    """The place after the colon that ends the signature of the def at ``i``, or -1."""
    depth = 0
    while i < len(text):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "#":
            i = text.find("\n", i)
            if i < 0:
                return -1
        elif c in "\"'":
            q = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
            j = i + len(q)
            while j < len(text) and text[j : j + len(q)] != q:
                j += 2 if text[j] == "\\" else 1
            i = j + len(q) - 1
        elif c == ":" and depth == 0:
            return i + 1
        i += 1
    return -1


PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+", re.M)
PY_DOC = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*([rRuU]?)(\"\"\"|'''|\"|')", re.S)


def doc_in_text(text: str, language: str) -> str:
    """The docstring of the first def, or the last ``/** */`` comment before any code; '' if there is none."""
    text = text.replace("\r\n", "\n")
    if language == "python" or language not in ("javascript", "typescript") and PY_DEF.search(text):
        d = PY_DEF.search(text)
        at = skip_signature(text, d.end()) if d else -1
        m = PY_DOC.match(text, at) if at >= 0 else None
        if not m:
            return ""
        j, q = m.end(), m[2]
        while j < len(text) and text[j : j + len(q)] != q and (len(q) == 3 or text[j] != "\n"):
            j += 2 if text[j] == "\\" else 1
        return text[m.end() : j]
    i, doc = 0, ""
    while i < len(text):
        if text[i].isspace():
            i += 1
        elif text.startswith("//", i):
            i = text.find("\n", i) + 1 or len(text)
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = len(text) if end < 0 else end + 2
            if text.startswith("/**", i) and end - i > 4:
                doc = text[i:end]
            i = end
        else:
            break
    return doc


def document(docstring: pd.Series, text: pd.Series, name: pd.Series, language: pd.Series) -> pd.DataFrame:
    said, inherit = [], []
    for d, t, n, lang in zip(docstring, text, name, language, strict=True):
        d = d if isinstance(d, str) and d.strip() else doc_in_text(t, lang or "") if isinstance(t, str) else ""
        s = describe(clean(d)) if d.strip() else ""
        up = bool(INHERIT.search(s)) and len(WORD.findall(INHERIT.sub("", s))) < 4
        ok = not up and says_something(INHERIT.sub("", s), n or "")
        said.append(s if ok else None)
        inherit.append(up or not d.strip())
    return pd.DataFrame({"description": said, "inherit": inherit})


PY_BASES = r"(?m)^[ \t]*class\s+\w+\s*\(([^)]*)\)"
JS_BASES = r"(?m)\bclass\s+\w+(?:<[^>{]*>)?\s+extends\s+([\w$.]+)"


def in_files(chunks: DataFrame) -> DataFrame:
    """``chunks`` with a column ``file``; without paths all of a repository counts as one file."""
    return chunks.withColumn("file", F.coalesce(F.col("file_path"), F.lit("")) if "file_path" in chunks.columns else F.lit(""))


def stem_of(path: Column) -> Column:
    """The name by which a file is imported: its own without ending, or that of the directory it stands for."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), r"/(__init__|index)$", "")
    return F.regexp_extract(bare, r"([^/]*)$", 1)


def class_parents(chunks: DataFrame) -> DataFrame:
    """Rows ``repo_name, file, class, base_file, base`` from the headers of class chunks.

    The last segment of a dotted base names a class of the same file, else one of a file
    that an import statement with this name points to, else the only class of that name in
    the repository. A base that none of these tells is left open.
    """
    chunks = in_files(chunks)
    c = chunks.where("chunk_type = 'class' and text is not null and symbol_name is not null")
    bases = F.concat(F.split(F.regexp_extract("text", PY_BASES, 1), ","), F.array(F.regexp_extract("text", JS_BASES, 1)))
    heads = c.select("repo_name", "file", F.col("symbol_name").alias("class"), F.explode(bases).alias("base"))
    heads = heads.select("repo_name", "file", "class", F.trim("base").alias("full"), F.regexp_extract(F.trim("base"), r"^[\w$.]*?([\w$]+)$", 1).alias("base")).where("base <> ''").distinct()
    known = c.select("repo_name", "file", F.col("symbol_name").alias("class"))
    known = known.unionByName(chunks.where("parent_class is not null").select("repo_name", "file", F.col("parent_class").alias("class"))).distinct()
    targets = known.select("repo_name", F.col("file").alias("base_file"), F.col("class").alias("base"))
    same = heads.join(targets.withColumn("file", F.col("base_file")), ["repo_name", "file", "base"]).where("base <> class").withColumn("rank", F.lit(0))
    only = targets.groupBy("repo_name", "base").agg(F.count("*").alias("n"), F.min("base_file").alias("base_file")).where("n = 1")
    only = heads.join(only, ["repo_name", "base"]).where("base_file <> file or base <> class").withColumn("rank", F.lit(2))
    found = same.unionByName(only.drop("n"))
    if "imports_raw" in chunks.columns:
        said = chunks.select("repo_name", "file", F.explode("imports_raw").alias("line")).where("line is not null").distinct()
        module = F.coalesce(F.nullif(F.regexp_extract("line", r"(?:from|require\()\s*['\"]([^'\"]+)['\"]", 1), F.lit("")), F.regexp_extract("line", r"^\s*(?:from|import)\s+([\w.]+)", 1))
        stem = stem_of(F.regexp_replace(F.regexp_replace(module, r"\.(m?[jt]sx?)$", ""), r"(?<=\w)\.(?=\w)", "/"))
        said = said.select("repo_name", "file", stem.alias("stem"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([\w$]+)"), 1))).alias("word")).distinct()
        # The name itself is imported, or the module that it is dotted to.
        named = heads.withColumn("word", F.explode(F.array_distinct(F.array("base", F.regexp_extract("full", r"^([\w$]+)", 1)))))
        named = named.join(said, ["repo_name", "file", "word"]).drop("word").distinct()
        named = named.join(targets.withColumn("stem", stem_of(F.col("base_file"))), ["repo_name", "base", "stem"]).where("base_file <> file").withColumn("rank", F.lit(1))
        found = found.unionByName(named.drop("stem"))
    best = found.groupBy("repo_name", "file", "class", "full").agg(F.min(F.struct("rank", "base_file", "base")).alias("x"))
    return best.select("repo_name", "file", "class", "x.base_file", "x.base").distinct()


def documented_functions(chunks: DataFrame) -> DataFrame:
    """Every function chunk once, with what its own documentation says (null: nothing) and whether it may inherit."""
    f = in_files(chunks).where("chunk_type = 'function' and chunk_id is not null").select("chunk_id", "repo_name", "file", "symbol_name", "parent_class", F.pandas_udf(document, "description string, inherit boolean")("docstring", "text", "symbol_name", "language").alias("d"))
    f = f.select("chunk_id", "repo_name", "file", "symbol_name", "parent_class", F.col("d.description").alias("description"), F.col("d.inherit").alias("inherit"))
    return f.dropDuplicates(["chunk_id"])


def documentation_pairs(chunks: DataFrame) -> DataFrame:
    """Functions with the description that documents them.

    Result: ``chunk_id, symbol_name, description, origin``, one row per documented
    function; ``origin`` is ``own`` or ``inherited``. Functions that say nothing and
    inherit nothing, however far up, are dropped; cycles of classes end. Of repeated
    rows one counts; a chunk without id is left out; null texts, names or languages document
    nothing or count as empty; where several bases document a method the one with
    the smallest chunk_id gives it. Other columns are not read.
    """
    functions = checkpoint(documented_functions(chunks))
    own = functions.where("description is not null").select("chunk_id", "symbol_name", "description", F.lit("own").alias("origin"))
    given = functions.where("description is not null and parent_class is not null").select("repo_name", "file", F.col("parent_class").alias("class"), "symbol_name", F.struct("chunk_id", "description").alias("doc"))
    given = given.groupBy("repo_name", "file", "class", "symbol_name").agg(F.min("doc").alias("doc"))
    parents = checkpoint(class_parents(chunks))
    up = functions.where("description is null and inherit and parent_class is not null").select("chunk_id", "repo_name", "symbol_name", "file", F.col("parent_class").alias("class"))
    # Each function meets each class once, so the rounds end where no new class is left, cycles included.
    seen = up.select("chunk_id", "file", "class").distinct()
    found = []
    while True:
        up = up.join(parents, ["repo_name", "file", "class"]).select("chunk_id", "repo_name", "symbol_name", F.col("base_file").alias("file"), F.col("base").alias("class")).distinct()
        up = up.join(seen, ["chunk_id", "file", "class"], "left_anti")
        tried = checkpoint(up.join(given, ["repo_name", "file", "class", "symbol_name"], "left"))
        hit = tried.where("doc is not null").groupBy("chunk_id").agg(F.first("symbol_name").alias("symbol_name"), F.min("doc").alias("doc"))
        found.append(hit.select("chunk_id", "symbol_name", F.col("doc.description").alias("description"), F.lit("inherited").alias("origin")))
        up = tried.where("doc is null").drop("doc").join(hit.select("chunk_id"), "chunk_id", "left_anti")
        if up.isEmpty():
            break
        seen = checkpoint(seen.unionByName(up.select("chunk_id", "file", "class")).join(up.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    for f in found:
        own = own.unionByName(f)
    return own
