"""Sentence boundaries across languages and scripts (problem 10).

A document is cut into blocks (fenced code, headings, list item lines, paragraphs);
within a block a semi-Markov dynamic program chooses whole sentence spans. A span
scores its length, the word it opens with, the word it closes with and whether its
quotations and parentheses are balanced, and the best chain of spans wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import spread

# Abbreviations after which a sentence goes on, whatever follows.
NEVER_END = set(
    "mr mrs ms dr prof rev gen col sgt capt lt st hon sr jr messrs mme mlle mlles mm fig figs sec eq eqs ch vol nos pp ed eds cf vs viz approx ca al dept est min max e.g i.e eg ie resp no art para app tab ex "
    "bzw vgl nr bspw z.b d.h u.a z.t i.d.r s.o s.u o.ä evtl ggf inkl zzgl tel str hr fr abb kap bd mind sog "
    "env c.-à-d p.ex av boul chap mgr vol réf sr sra srta dra pág págs p.ej aprox núm art cap ej ud uds dña d.ª "
    "т.е т.к т.н рис прим см ср стр гл табл ок им проф д-р г-н г-жа ул напр тел डॉ श्री प्रो د أ م ص".split()
)
# Abbreviations that may also close a sentence; a capital after them starts a new one.
MAY_END = set("etc usw u.s.w inc ltd co corp a.m p.m u.s u.k u.n e.u b.c a.d m min s h sek std т.д т.п др г гг в вв млн тыс руб и.т.д ff f op vol jan feb mar apr jun jul aug sep sept oct nov dec".split())
# Month names, words before ordinal numbers, and common opening words.
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner january february march may june july october december".split())
ORDINAL_LEADS = set("am im der die das den dem des vom zum beim bis ab seit ersten jeden eine ein dieser diesem und".split())
OPENERS = set("the a an it this that these those in on at for he she we they you i there when if but and so as what why how where who is are do does each every no neither der die das ein eine er sie es wir im in wenn le la les un une il elle nous el los las una".split())
# Words and particles that carry on a sentence after a closed quotation, in scripts without capitals.
CARRY_ON = ("と", "って", "という", "との", "とい", "に", "が", "を", "は", "も", "の", "で", "然后", "然後", "的", "地说", "他说", "她说", "我说", "说道", "問道", "问道", "说", "道，", "並", "并且", "并", "而", "就")
OPEN, CLOSE = "“‘«「『（([{【〈《„‚¿¡", "”’»」』）)]}】〉》"
PAIRS = {"”": "“„", "“": "„", "’": "‘", "»": "«", "«": "»", "」": "「", "』": "『", "）": "（", ")": "(", "]": "[", "}": "{", "】": "【", "〉": "〈", "》": "《"}
TERMINATOR = re.compile(r"""(?P<t>[.!?…。！？｡؟۔।॥‼⁇⁈⁉]+)(?P<c>(?:["'”’“»」』）)\]】》*_`]|[   ](?=»)»?)*)""")
WIDE = re.compile(r"[。！？｡।॥؟۔]")
NO_SPACE = re.compile(r"[⺀-鿿가-힯豈-﫿＀-￯]")
THAI_GAP = re.compile(r"(?<=[฀-๿຀-໿ក-៿က-႟])\s+(?=[฀-๿຀-໿ក-៿က-႟])")
CASELESS = re.compile(r"[֐-๿຀-࿿က-႟ក-៿⺀-鿿가-힯豈-﫿]")
IDENTIFIER = re.compile(r"[a-z_$][\w$]*(?:_[\w$]+|\(\)|[a-z][A-Z]\w*|\.\w+\()|[a-z]+[A-Z]\w*")
FENCE = re.compile(r"^\s{0,12}(`{3,}|~{3,})")
HEADING = re.compile(r"^\s{0,3}#{1,6}(?:\s+\S|\s*$)")
ITEM = re.compile(r"^\s*(?:[-*+•‣◦–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])\s+(?=\S)")
#: Within a paragraph a wrapped line may begin with a number or a dash; only these begin a list there.
INTERRUPTS = re.compile(r"^\s*(?:[-*+•‣◦]|1[.)])\s")
INVISIBLE = " \t\n\r\x0b\x0c\xa0\u2009\u202f\u3000\u200b\u200c\u200d\u2060\ufeff"
WORD_BEFORE = re.compile(r"[^\s\"'“”„«»‘’()\[\]{}（）「」『』,;:!?，、：；]*$")


#: Words of a span that cost nothing, and what each further one costs.
LONG, LOSS = 60, 0.05


def depths(s: str) -> list[int]:
    """Open quotations and parentheses before each character; straight double quotes and backticks take turns."""
    out, stack = [0] * (len(s) + 1), []
    for i, c in enumerate(s):
        out[i] = len(stack)
        if c in "\"`":
            if c in stack:
                del stack[stack.index(c) :]
            else:
                stack.append(c)
        elif c == "“" and "„" in stack:
            del stack[len(stack) - 1 - stack[::-1].index("„") :]
        elif c in "“‘«「『（([{【〈《„‚" and not (c == "‘" and i and s[i - 1].isalnum()):
            stack.append(c)
        elif c in PAIRS:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k] in PAIRS[c]), None)
            if at is not None:
                del stack[at:]
    out[len(s)] = len(stack)
    return out


BLANKS = re.compile(rf"[\s{INVISIBLE}]*")
LEAD_MARKS = re.compile(r"""[\"'“‘«„‚「『（(\[¿¡*_`»]*""")
EDGES = re.compile("[\u00a0 ]*")
OPENER = re.compile(r"[\w$]+(?:['’]\w+)?")
INITIAL = re.compile(r"[^\W\d_]\.")
LAST_WORD = re.compile(r"(\w+)$")


def boundary(s: str, m: re.Match, end: int) -> float | None:
    """How much the closing word before ``m`` and the opening word after ``end`` speak for a boundary; None where there can be none."""
    t, start = m["t"], BLANKS.match(s, end).end()
    if start == len(s):
        return 9.0
    gap, first = start > end, s[start]
    wide = bool(WIDE.search(t)) and bool(re.search(r"[。！？｡]", t)) or "…" in t and bool(NO_SPACE.match(first))
    if not gap and not wide and not (NO_SPACE.match(first) and t[-1] in "!?…") and not (first in "“«„「『¿¡" and m["c"]):
        return None
    score = 3.0
    k = LEAD_MARKS.match(s, start).end()
    at = EDGES.match(s, k).end() if k > start else k
    opener = OPENER.match(s, at)
    word = opener[0] if opener else ""
    if first in "—–-" and re.compile(r"[—–-]+\s").match(s, start) or first in ",;:，、；：。.)）]":
        return -9.0
    if at == len(s):
        score -= 1
    elif CASELESS.match(s, at):
        score += 1
        if (m["c"] or "…" in t) and k == start and s.startswith(CARRY_ON, at):
            score -= 8
    elif IDENTIFIER.match(s, at):
        score += 0.5
    elif s[at].islower():
        score -= 9
    elif s[at].isupper():
        score += 1
    if "." in t and set(t) <= {"."} and len(t) == 1 and not m["c"].strip("*_`"):
        as_is = WORD_BEFORE.search(s, max(0, m.start() - 40), m.start())[0].lstrip("*_`ـ")
        before = as_is.lower()
        chain = re.search(r"(?:\b[^\W\d_]{1,3}\.[  ]?)+[^\W\d_]{1,3}$", s[max(0, m.start() - 12) : m.start()])
        joined = re.sub(r"[\s ]", "", chain[0]).lower() if chain else before
        upper = bool(word) and word[0].isupper()
        if len(as_is) == 1 and as_is.isalpha() and INITIAL.match(s, at):  # z. B., A. B.
            score -= 9
        elif len(as_is) == 1 and as_is.isupper() and not chain:
            score -= 3 if word.lower() in OPENERS else 9
        elif joined in MAY_END or before in MAY_END and not chain:
            score -= 0 if upper or IDENTIFIER.match(s, at) or CASELESS.match(s, at) else 9
            if before in ("no", "min", "s", "m", "h") and s[at : at + 1].isdigit():
                score -= 9
            if joined in ("u.s", "u.k", "u.n", "e.u") and word.lower() not in OPENERS:
                score -= 5
        elif joined in NEVER_END or before in NEVER_END:
            score -= 9
            if before == "no" and upper:
                score += 9
        elif re.fullmatch(r"\d{1,4}", before):
            number = m.start() - len(before)
            gone = number
            while gone and s[gone - 1].isspace():
                gone -= 1
            lead = LAST_WORD.search(s, max(0, gone - 40), gone) if gone < number else None
            if word.lower() in MONTHS or lead and lead[1].lower() in ORDINAL_LEADS and len(before) < 3 and upper and word.lower() not in OPENERS:
                score -= 9
            elif not gone:
                score -= 9
        elif chain and len(joined) < 8 and "." in joined:
            score -= 3 if word.lower() in OPENERS else 9
    return score


def split_block(s: str) -> list[int]:
    """Ends of the sentence spans of one block of text, by dynamic programming over its possible boundaries."""
    cands: dict[int, float] = {}
    for m in TERMINATOR.finditer(s):
        end = m.end()
        while end > m.end("t") and s[end - 1] in "   ":
            end -= 1
        if (v := boundary(s, m, end)) is not None:
            cands[end] = max(v, cands.get(end, -99))
    for m in THAI_GAP.finditer(s):
        cands.setdefault(m.start(), 3.0)
    end = len(s.rstrip())
    if not end:
        return []
    cands = {p: v for p, v in cands.items() if p < end and s[p:].strip()}
    if not cands:
        return [end]
    at = [0, *sorted(cands), end]
    deep = depths(s)
    length = [0]
    for a, b in zip(at, at[1:], strict=False):  # words, in scripts without spaces about two characters
        wide = len(NO_SPACE.findall(s, a, b))
        length.append(length[-1] + (wide / 2 if wide else len(s[a:b].split())))
    best, back = [0.0], [0]
    # Beyond LONG words a span loses the same for every further word, so of all far beginnings with one depth a
    # single one can be best: the one that leads in best + LOSS * length. It is kept by depth; only near ones are tried.
    far: dict[int, tuple[float, int]] = {}
    near = 0
    for j in range(1, len(at)):
        own, top, arg, d = cands.get(at[j], 0.0), -1e18, 0, deep[at[j]]
        while near < j and length[j] - length[near] > LONG:
            lead, k = best[near] + LOSS * length[near], deep[at[near]]
            if k not in far or lead >= far[k][0]:
                far[k] = lead, near
            near += 1
        for i in range(j - 1, near - 1, -1):
            span = -(0.5 if length[j] - length[i] < 2 else 0.0) - 4.0 * min(2, abs(d - deep[at[i]]))
            if best[i] + span > top:
                top, arg = best[i] + span, i
        for k, (lead, i) in far.items():
            score = lead - LOSS * (length[j] - LONG) - 4.0 * min(2, abs(d - k))
            if score > top + 1e-9 or abs(score - top) <= 1e-9 and i > arg:
                top, arg = score, i
        best.append(top + own)
        back.append(arg)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def unit_ends(text: str) -> list[int]:
    """Offsets just after each sentence unit of a document."""
    ends: list[int] = []
    lines, at = text.split("\n"), 0
    para: list[int] = []  # start and end of the paragraph that is being read

    def close() -> None:
        if para:
            ends.extend(para[0] + e for e in split_block(text[para[0] : para[1]]))
            para.clear()

    i = 0
    while i < len(lines):
        line, start = lines[i], at
        at += len(line) + 1
        i += 1
        if m := FENCE.match(line):
            close()
            stop = start + len(line.rstrip())
            while i < len(lines):
                inner, begin = lines[i], at
                at += len(inner) + 1
                i += 1
                if inner.strip():
                    stop = begin + len(inner.rstrip())
                bare = inner.strip()
                if bare.startswith(m[1]) and not bare.strip(m[1][0]):
                    break
            ends.append(stop)
        elif not line.strip():
            close()
        elif HEADING.match(line):
            close()
            ends.append(start + len(line.rstrip()))
        elif (m := ITEM.match(line)) and (not para or INTERRUPTS.match(line)):
            close()
            ends.extend(start + m.end() + e for e in split_block(line[m.end() :]))
        elif para:
            para[1] = start + len(line)
        else:
            para[:] = [start, start + len(line)]
    close()
    return ends


def _cut(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """``id, ends`` of every row, with its ``text`` if that is asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                columns = [part.column(0), pa.array([unit_ends(t) for t in part.column(1).to_pylist()], pa.list_(pa.int64())), part.column(1)]
                yield pa.RecordBatch.from_arrays(columns[: 2 + with_text], ["id", "ends", "text"][: 2 + with_text])

    return spread(src, "id").mapInArrow(run, f"id {kind}, ends array<long>" + ", text string" * with_text)


def sentence_ends(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, end_char`` of every sentence unit; as ``sentence_units``, but no text is moved."""
    ends = _cut(docs, id_col, text_col, with_text=False).dropDuplicates(["id"])
    return ends.select(F.col("id").alias(id_col), F.explode("ends").alias("end_char"))


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentence units of every document.

    Result: ``<id_col>, unit, start_char, end_char, sentence``, one row per unit in
    order from 0; offsets count code points. Null ids are left out; null, empty and
    blank texts have no unit; of a repeated id one row counts; other columns are not
    read.
    """
    units = _cut(docs, id_col, text_col, with_text=True).dropDuplicates(["id"])
    prior = F.when(F.col("unit") > 0, F.element_at("ends", F.col("unit"))).otherwise(F.lit(0)).cast("long")
    units = units.select("id", "text", "ends", F.posexplode("ends").alias("unit", "end_char"))
    body = F.substring("text", (prior + 1).cast("int"), (F.col("end_char") - prior).cast("int"))
    units = units.select("id", "unit", "end_char", body.alias("body"))
    sentence = F.regexp_replace("body", r"^[\s ]+", "")
    return units.select(F.col("id").alias(id_col), "unit", (F.col("end_char") - F.length(sentence)).alias("start_char"), "end_char", sentence.alias("sentence"))
