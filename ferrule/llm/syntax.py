"""Source files that do not parse (problem 6).

Files are lexed into rows. Adjacent token pairs are anti-joined with the pairs that
the grammar permits, which are derived from the productions below by their first and
last tokens. Brackets are checked by windowed reductions: a running depth per file,
and at each depth the opener that a closer meets. Statement productions, with the
rules on names and scopes, are reduced over each file's tokens. Only a file that one
of the three rejects is then confirmed: by the compiler of this Python, or by the
productions of JavaScript and TypeScript.
"""

from __future__ import annotations

import keyword
import re
import sys
import token
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm import ecma, pysource
from ferrule.runtime import checkpoint, spread

PYTHON_GRAMMAR = """
file: { NEWLINE | stmt } END
stmt: simple NEWLINE | compound
simple: small { ';' small } [ ';' ]
small: assign | 'pass' | 'break' | 'continue' | 'return' [ exprs ] | 'raise' [ expr [ 'from' expr ] ] | 'global' NAME { ',' NAME } | 'nonlocal' NAME { ',' NAME } | 'del' exprs | 'assert' expr [ ',' expr ] | imports | alias
alias: SOFT NAME [ '[' params ']' ] '=' expr
assign: [ SOFT ':=' ] exprs [ ':' expr ] { '=' value } | exprs AUG value
value: exprs | yield
yield: 'yield' [ 'from' expr | exprs ]
imports: 'import' modules | 'from' ( dots [ dotted ] | dotted ) 'import' ( '*' | '(' names [ ',' ] ')' | names )
dots: ( '.' | '...' ) { '.' | '...' }
dotted: NAME { '.' NAME }
modules: dotted [ 'as' NAME ] { ',' dotted [ 'as' NAME ] }
names: NAME [ 'as' NAME ] { ',' NAME [ 'as' NAME ] }
compound: head ':' suite | { '@' expr NEWLINE } def
def: [ 'async' ] 'def' NAME [ '[' params ']' ] '(' [ params ] ')' [ '->' expr ] ':' suite | 'class' NAME [ '[' params ']' ] [ '(' [ args ] ')' ] ':' suite
head: 'if' expr | 'elif' expr | 'else' | 'while' expr | [ 'async' ] 'for' exprs 'in' exprs | 'try' | 'except' [ '*' ] [ exprs [ 'as' NAME ] ] | 'finally' | [ 'async' ] 'with' with | SOFT exprs | SOFT patterns [ 'if' expr ]
with: item { ',' item } [ ',' ] | '(' item { ',' item } [ ',' ] ')'
item: expr [ 'as' expr ]
patterns: pattern { ( ',' | '|' ) pattern } [ ',' ]
pattern: expr [ 'as' NAME ] | '*' NAME
suite: simple NEWLINE | NEWLINE INDENT stmt { stmt } DEDENT
params: param { ',' param } [ ',' ]
param: [ '*' | '**' ] NAME [ ':' [ '*' ] expr ] [ '=' expr ] | '*' | '/'
args: arg { ',' arg } [ ',' ]
arg: expr [ comp ] | NAME '=' expr | '*' expr | '**' expr
exprs: star { ',' star } [ ',' ]
star: [ '*' ] expr
expr: lambda | named [ 'if' named 'else' expr ]
lambda: 'lambda' [ params ] ':' expr
named: [ NAME ':=' ] unary { BIN unary }
unary: { 'not' | '-' | '+' | '~' | 'await' } primary
primary: atom { '.' NAME | '(' [ args ] ')' | '[' subs ']' }
subs: sub { ',' sub } [ ',' ]
sub: star | [ expr ] ':' [ expr ] [ ':' [ expr ] ]
atom: NAME | SOFT | NUMBER | STRING { STRING } | 'None' | 'True' | 'False' | '...' | '(' [ yield | exprs [ comp ] ] ')' | '[' [ exprs [ comp ] ] ']' | '{' [ entry { ',' entry } [ ',' ] [ comp ] ] '}'
entry: star [ ':' expr ] | '**' expr
comp: [ 'async' ] 'for' exprs 'in' expr { 'if' expr | [ 'async' ] 'for' exprs 'in' expr }
"""
ECMA_GRAMMAR = """
file: { stmt } END
stmt: block | ';' | [ mods ] ( 'var' | 'const' | NAME ) declarators [ ';' ] | [ mods ] function | [ mods ] class | 'if' '(' exprs ')' stmt [ 'else' stmt ] | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' [ ';' ] | for | ( 'break' | 'continue' ) [ NAME ] [ ';' ] | 'return' [ exprs ] [ ';' ] | 'throw' exprs [ ';' ] | 'try' block [ 'catch' [ '(' binding ')' ] block ] [ 'finally' block ] | 'switch' '(' exprs ')' '{' { 'case' exprs ':' { stmt } | 'default' ':' { stmt } } '}' | 'with' '(' exprs ')' stmt | 'debugger' [ ';' ] | NAME ':' stmt | exprs [ ';' ] | import | export | types
mods: NAME { NAME } | 'export' [ 'default' ] { NAME } | decorator { decorator }
decorator: '@' unary
block: '{' { stmt } '}'
declarators: declarator { ',' declarator }
declarator: target [ '!' ] [ ':' type ] [ '=' assign ]
target: NAME | '[' { ',' | [ '...' ] element } ']' | '{' { prop [ ',' ] } '}'
element: binding
prop: '...' target | key [ ':' target ] [ '=' assign ]
binding: [ mods ] [ '...' ] ( target | 'this' ) [ '?' ] [ ':' type ] [ '=' assign ]
for: 'for' [ NAME ] '(' ( [ [ 'var' | 'const' | NAME ] declarators | exprs ] ';' [ exprs ] ';' [ exprs ] | [ 'var' | 'const' | NAME ] ( target | unary ) ( NAME | 'in' ) exprs ) ')' stmt
function: [ NAME ] 'function' [ '*' ] [ NAME ] signature ( block | ';' | )
signature: [ typeparams ] '(' [ binding { ',' binding } [ ',' ] ] ')' [ ':' type ]
class: 'class' [ NAME ] [ typeparams ] [ 'extends' unary [ typeargs ] ] [ NAME type { ',' type } ] '{' { member } '}'
member: ';' | { decorator } [ mods ] [ '*' ] key [ '?' | '!' ] ( signature ( block | ';' | ) | [ ':' type ] [ '=' assign ] [ ';' ] ) | NAME block | [ mods ] '[' NAME ':' type ']' [ ':' type ] [ ';' ]
key: word | STRING | NUMBER | '[' assign ']'
word: [ '#' ] ( NAME | RESERVED )
import: 'import' ( STRING | ( [ NAME ] ( NAME | '*' NAME NAME | specs ) [ ',' ( '*' NAME NAME | specs ) ] NAME STRING ) ) [ ( NAME | 'with' ) object ] [ ';' ] | 'import' NAME '=' exprs [ ';' ]
specs: '{' [ spec { ',' spec } [ ',' ] ] '}'
spec: [ NAME ] ( word | STRING ) [ NAME ( word | STRING ) ]
export: 'export' ( 'default' assign [ ';' ] | '*' [ NAME word ] NAME STRING [ ';' ] | [ NAME ] specs [ NAME STRING ] [ ';' ] | '=' exprs [ ';' ] | stmt )
exprs: assign { ',' assign }
assign: arrow | 'yield' [ '*' ] [ assign ] | unary { BIN unary | 'in' unary | '<' unary | '>' unary | '*' unary | '-' unary | '+' unary | '/' unary | NAME type } [ '?' assign ':' assign ] [ ( '=' | AUG ) assign ]
arrow: [ NAME ] ( NAME | signature ) '=>' ( block | assign )
unary: { '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | NAME } operand [ '++' | '--' ]
operand: primary { '.' word | '?.' ( word | '(' [ args ] ')' | '[' exprs ']' ) | '(' [ args ] ')' | '[' exprs ']' | TEMPLATE | '!' | typeargs }
primary: NAME | NUMBER | STRING | TEMPLATE | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' exprs ')' | '[' { ',' | [ '...' ] assign } ']' | object | function | class | 'new' [ '.' NAME ] operand | 'import' ( '(' args ')' | '.' NAME ) | '#' NAME | typeargs unary
args: [ '...' ] assign { ',' [ '...' ] assign } [ ',' ]
object: '{' [ entry { ',' entry } [ ',' ] ] '}'
entry: '...' assign | [ mods ] [ '*' ] key ( [ ':' assign ] | signature block ) | NAME '=' assign
types: [ mods ] NAME NAME [ typeparams ] ( [ 'extends' type { ',' type } ] members | '=' type [ ';' ] ) | [ mods ] 'enum' NAME '{' [ key [ '=' assign ] { ',' key [ '=' assign ] } [ ',' ] ] '}' | [ mods ] NAME ( NAME { '.' NAME } | STRING ) block
typeparams: '<' [ 'const' | 'in' ] NAME [ 'extends' type ] [ '=' type ] { ',' NAME [ 'extends' type ] [ '=' type ] } [ ',' ] '>'
typeargs: '<' type { ',' type } '>'
type: [ '|' | '&' ] single { ( '|' | '&' ) single } [ 'extends' type '?' type ':' type ] | [ NAME ] [ 'new' ] [ typeparams ] '(' [ binding { ',' binding } [ ',' ] ] ')' '=>' type | NAME NAME type
single: [ NAME ] tatom { '[' [ type ] ']' }
tatom: ( NAME | 'this' | 'null' | 'void' | 'true' | 'false' ) { '.' word } [ typeargs ] | STRING | NUMBER | '-' NUMBER | TEMPLATE | 'typeof' word { '.' word } | 'import' '(' type ')' { '.' word } | '(' type ')' | '[' [ [ '...' ] [ NAME [ '?' ] ':' ] type [ '?' ] { ',' [ '...' ] [ NAME [ '?' ] ':' ] type [ '?' ] } [ ',' ] ] ']' | members
members: '{' { [ '-' | '+' ] [ mods ] ( signature | 'new' signature | key [ '?' ] ( [ ':' type ] | signature ) | '[' NAME ( ':' | 'in' ) type [ NAME type ] ']' [ '-' | '+' ] [ '?' ] [ ':' type ] ) [ ';' | ',' ] } '}'
"""
#: Words of a language that stand for themselves in its grammar, operators that share a class.
PY_WORDS = set(keyword.kwlist)
PY_BIN = set("+ - * / // % @ ** << >> & | ^ < > == >= <= != and or in is not".split())
PY_AUG = set("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
EC_BIN = set("== != === !== <= >= << >> >>> % ** & | ^ && || ?? instanceof".split())


@lru_cache(2)
def permitted(grammar: str) -> frozenset[tuple[str, str]]:
    """Pairs of tokens that some text of the grammar has side by side."""
    rules = {}
    for line in grammar.strip().split("\n"):
        head, _, body = line.partition(":")
        rules[head.strip()] = re.findall(r"'[^']+'|\w+|[()\[\]{}|]", body)
    info = {k: (False, frozenset(), frozenset()) for k in rules}  # nullable, first, last
    pairs: set[tuple[str, str]] = set()

    def alternatives(toks: list[str], i: int) -> tuple[tuple, int]:
        out = (False, frozenset(), frozenset())
        while True:
            one, i = sequence(toks, i)
            out = (out[0] or one[0], out[1] | one[1], out[2] | one[2])
            if i < len(toks) and toks[i] == "|":
                i += 1
            else:
                return out, i

    def sequence(toks: list[str], i: int) -> tuple[tuple, int]:
        null, first, last = True, frozenset(), frozenset()
        while i < len(toks) and toks[i] not in ")]}|":
            t = toks[i]
            if t in "([{":
                item, i = alternatives(toks, i + 1)
                if t == "{":
                    pairs.update((a, b) for a in item[2] for b in item[1])
                if t != "(":
                    item = (True, item[1], item[2])
            else:
                item = info[t] if t in info else (False, frozenset([t.strip("'")]), frozenset([t.strip("'")]))
            i += 1
            pairs.update((a, b) for a in last for b in item[1])
            first, last = first | item[1] if null else first, last | item[2] if item[0] else item[2]
            null = null and item[0]
        return (null, first, last), i

    while True:
        before = dict(info), len(pairs)
        for k, toks in rules.items():
            info[k] = alternatives(toks, 0)[0]
        if before == (info, len(pairs)):
            return frozenset(pairs)


def classes(word: str, binary: set[str], augmented: set[str]) -> list[str]:
    """The names under which a grammar may know an operator or keyword."""
    return [word] + ["BIN"] * (word in binary) + ["AUG"] * (word in augmented)


def permitted_rows() -> list[tuple[str, str, str]]:
    """Language, left and right token of every permitted pair, over the tokens as lexed."""
    out = []
    for lang, grammar, binary, augmented in (("python", PYTHON_GRAMMAR, PY_BIN, PY_AUG), ("ecma", ECMA_GRAMMAR, EC_BIN, ecma.ASSIGN - {"="})):
        for a, b in permitted(grammar):
            left = binary if a == "BIN" else augmented if a == "AUG" else ecma.RESERVED if a == "RESERVED" else [a]
            right = binary if b == "BIN" else augmented if b == "AUG" else ecma.RESERVED if b == "RESERVED" else [b]
            out += [(lang, x, y) for x in left for y in right]
    # Two-word operators of Python, and fresh beginnings.
    out += [("python", "not", "in"), ("python", "is", "not")]
    return sorted(set(out))


#: Frames that a worker's productions may nest. They lie on the heap, not on the machine's stack, some 500 bytes each.
FRAMES = 300_000


def lex_python(text: str) -> tuple[list[str], list[tuple[int, str]], str]:
    """Tokens as the grammar names them (formatted strings as one), as they are read, and what lexical rule is broken, if any."""
    tokens, fault = pysource.read(text)
    out: list[str] = []
    inside = 0
    for kind, text_ in tokens:
        if kind == token.FSTRING_START:
            inside += 1
            if inside == 1:
                out.append("STRING")
        elif kind == token.FSTRING_END:
            inside -= 1
        elif inside:
            continue
        elif kind == token.NAME:
            begins = not out or out[-1] in ("NEWLINE", "INDENT", "DEDENT", ":", ";")
            out.append(text_ if text_ in PY_WORDS else "SOFT" if begins and text_ in ("match", "case", "type") else "NAME")
        else:
            out.append("END" if kind == token.ENDMARKER else text_ if kind == token.OP else token.tok_name[kind])
    return out, tokens, fault


def language_group(language: str | None) -> str | None:
    return {"python": "python", "javascript": "ecma", "typescript": "ecma"}.get(language or "")


def lexed_rows(language: str, text: str) -> tuple[str, list[tuple[str, str]], list[str]]:
    """Lexical or production fault, adjacent pairs (distinct), and the brackets in order."""
    if language == "python":
        toks, tokens, fault = lex_python(text)
        try:
            fault = fault or pysource.fault_of(tokens)
        except RecursionError:
            pass  # nested too deep to tell: pairs and brackets decide
        pairs = set(zip(toks, toks[1:], strict=False))
    else:
        try:
            tokens, _ = ecma.lex(text)
        except ecma.Bad as e:
            return str(e) or "lexical", [], []
        except RecursionError:
            return "", [], []  # nested too deep to tell
        names = {"n": "NAME", "d": "NUMBER", "s": "STRING", "t": "TEMPLATE", "r": "REGEX", "e": "END"}
        toks = [t.text if t.kind == "p" or t.kind == "n" and t.text in ecma.RESERVED else names[t.kind] for t in tokens]
        if language == "typescript":  # closing angle brackets of types are lexed as shifts
            toks = [">" if t in (">>", ">>>") else t for t in toks]
        # A line break may stand for a semicolon, so only pairs within a line are certain.
        pairs = {(a, b) for a, b, t in zip(toks, toks[1:], tokens[1:], strict=False) if not t.line_before and t.kind != "e"}
        fault = ecma.fault_of(tokens, language == "typescript")
    return fault, sorted(pairs), [t for t in toks if t in ("(", "[", "{", ")", "]", "}")]


def confirmed(language: str, text: str) -> bool | None:
    """Whether the language's own rules reject the text; None if it is nested too deep for them to tell."""
    if language != "python":
        try:
            return bool(ecma.check(text, language == "typescript", deep=True))
        except RecursionError:
            return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file", "exec", dont_inherit=True)
        return False
    except (SyntaxError, ValueError):
        return True
    except (RecursionError, MemoryError):
        return None


def invalid_files(files: DataFrame, id_col: str = "file_id", content: str = "content", language: str = "language") -> DataFrame:
    """Files that are no valid source of their language.

    Result: ``<id_col>, reason``, one row per file; ``reason`` is ``pair``, ``nesting``
    or the broken rule. Only python, javascript and typescript are judged; null ids,
    contents and other languages give nothing, an empty text is valid; of a repeated
    id one row counts; other columns are not read.
    """
    spark = files.sparkSession
    kind = files.schema[id_col].dataType.simpleString()
    src = files.where(F.col(id_col).isNotNull() & F.col(content).isNotNull() & F.col(language).isin("python", "javascript", "typescript"))
    src = src.select(F.col(id_col).alias("id"), F.col(language).alias("language"), F.col(content).alias("content"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(FRAMES)
        for b in it:
            rows = [lexed_rows(lang, text) for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            langs = ["python" if x == "python" else "ecma" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "grammar": langs, "fault": [r[0] for r in rows], "lefts": [[p[0] for p in r[1]] for r in rows], "rights": [[p[1] for p in r[1]] for r in rows], "brackets": [r[2] for r in rows]}, schema=pa.schema([("id", b.column(0).type), ("grammar", pa.string()), ("fault", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("brackets", pa.list_(pa.string()))]))

    lexed = spread(src, "id").mapInArrow(run, f"id {kind}, grammar string, fault string, lefts array<string>, rights array<string>, brackets array<string>")
    lexed = checkpoint(lexed.dropDuplicates(["id"]))
    # The permitted pairs come from the fixed grammars, a few thousand rows whatever the data.
    allowed = F.broadcast(spark.createDataFrame(permitted_rows(), "grammar string, left string, right string"))
    pairs = lexed.select("id", "grammar", F.explode(F.arrays_zip(F.col("lefts").alias("left"), F.col("rights").alias("right"))).alias("p")).select("id", "grammar", "p.left", "p.right")
    odd = pairs.join(allowed, ["grammar", "left", "right"], "left_anti").select("id", F.lit("pair").alias("reason")).distinct()
    # Nesting: depth by a running sum; at each depth openers and closers must take turns and match.
    step = F.when(F.col("b").isin("(", "[", "{"), 1).otherwise(-1)
    br = lexed.select("id", F.posexplode("brackets").alias("pos", "b")).withColumn("step", step)
    br = br.withColumn("depth", F.sum("step").over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    br = br.withColumn("level", F.when(F.col("step") > 0, F.col("depth")).otherwise(F.col("depth") + 1))
    w = Window.partitionBy("id", "level").orderBy("pos")
    br = br.withColumn("opener", F.lag("b").over(w))
    wrong = F.col("depth") < 0
    wrong = wrong | (F.col("step") < 0) & (F.concat("opener", "b").isin("()", "[]", "{}") == F.lit(False)) | (F.col("step") < 0) & F.col("opener").isNull()
    unclosed = br.groupBy("id").agg(F.sum("step").alias("left_open"), F.max(wrong).alias("wrong")).where("left_open <> 0 or wrong")
    nesting = unclosed.select("id", F.lit("nesting").alias("reason"))
    broken = lexed.where("fault <> ''").select("id", F.col("fault").alias("reason"))
    suspects = odd.unionByName(nesting).unionByName(broken).groupBy("id").agg(F.min("reason").alias("reason"))

    def confirm(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(FRAMES)
        for b in it:
            # What is too deep to confirm keeps the verdict of the steps that made it a suspect.
            bad = [confirmed(lang, t) is not False for lang, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            keep = pa.array(bad, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(3).filter(keep)], ["id", "reason"])

    judged = src.join(suspects, "id").select("id", "language", "content", "reason")
    return judged.mapInArrow(confirm, f"id {kind}, reason string").dropDuplicates(["id"]).withColumnRenamed("id", id_col)


def invalid_rates(files: DataFrame, found: DataFrame, id_col: str = "file_id", repo: str = "repo_name", language: str = "language") -> DataFrame:
    """Files judged, invalid ones and their share per repository and language."""
    f = files.where(F.col(id_col).isNotNull() & F.col(language).isin("python", "javascript", "typescript")).select(id_col, repo, language).dropDuplicates([id_col])
    f = f.join(found.select(id_col, F.lit(1).alias("bad")), id_col, "left")
    return f.groupBy(repo, language).agg(F.count("*").alias("files"), F.count("bad").alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
