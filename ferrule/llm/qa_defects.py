"""Broken prompt and response pairs (problem 4).

Each response is compressed with its prompt as a zstandard dictionary: what costs
next to nothing then is a copy. Word dictionaries give the language of both sides
and recognise refusals. A terminal-context model, a logistic regression over how a
text ends, fitted here on whole responses against the same responses cut short,
tells finished from truncated ones.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Responses on which the terminal-context model is fitted, at most; it judges every response.
SAMPLE_ROWS = 20_000
#: Longer responses are left out of that sample.
SAMPLE_CHARS = 10_000

# Fillers that stand for no answer.
FILLER = re.compile(r"(n ?a|null|none|nil|nan|tbd|tba|todo|undefined|empty|no answer|unknown|not available|not applicable|to be (done|determined|added)|placeholder|lorem ipsum.*|k ?a|keine antwort|sans réponse|sin respuesta)", re.I)
# Common words of some languages.
COMMON = {
    "en": "the of and to in is that it for as with was on are be this by at from or which not have has an they you when then than so its first after before who what how why where does each only there cannot can",
    "de": "der die das und ist in zu den nicht von mit sich auf für im dem des ein eine einen als auch wird werden wurde an nach wie wenn aus er es sie vor kein keine warum wo wer zuerst danach durch bei noch wieder ich sind hat",
    "fr": "le la les de des du et est un une dans que qui pour pas sur au par plus ne se ce il elle avec sont ou été aux leur d'abord après avant pourquoi comment où quel quelle si aucune l' d' n' qu' je",
    "es": "el la los las de del y es un una en que para por con no se su al lo como más pero sus le ya o este si porque cuando sin sobre también hasta hay donde quien desde todo primero antes después cómo qué cuál dónde ninguna tras",
    "it": "il lo la gli le di del della e è un una in che per con non si da al come più ma nel anche sono alla dopo prima perché dove chi quando questo viene ogni",
    "pt": "o a os as de do da dos das e é um uma em que para por com não se no na mais como mas ao pelo pela são depois antes onde quem quando porque foi",
    "nl": "de het een en van is in op dat te niet met voor zijn aan er om ook als dan maar bij naar uit door wordt worden waarom hoe waar wie eerst daarna geen",
    "pl": "i w na z do nie się jest to że o jak po ale od za przez dla czy oraz który która gdzie dlaczego kiedy są",
    "sv": "och i att det som en på är av för med den till inte om har de ett han var jag från eller när efter före varför hur",
}
COMMON = {k: set(v.split()) for k, v in COMMON.items()}
# Openings that decline to answer.
REFUSAL = re.compile(
    "|".join(
        [
            r"\bi(?:['’]m| am)? (?:sorry|afraid|unable|not able|not allowed|not permitted)\b", r"\bi (?:can(?:no|['’])t|cannot|could not|couldn['’]t|do not|don['’]t|won['’]t|will not|am not able to|must|have to|need to|would rather not|['’]?d rather not)\b.{0,25}\b(?:answer|help|assist|say|tell|determine|discuss|comment|provide|share|respond|reply|decline|pass|refuse|know|look|access|disclose|give|reveal|guess|comply|fulfil|fulfill|be able to)",
            r"\bi don['’]?t (?:have (?:the|any|enough|access)|know)\b", r"\bi do not (?:have (?:the|any|enough|access)|know)\b", r"\bi (?:have|had) no (?:access|way|means|information|idea|knowledge)\b", r"\bi must decline\b", r"\bas an? (?:ai|large )?(?:language |ai )?(?:model|assistant)\b", r"\bmy (?:guidelines|policy|policies|instructions|rules) (?:do|does|don|forbid|prevent|prohibit)", r"\b(?:isn['’]t|is not|not) possible for me\b",
            r"\b(?:outside|beyond) (?:of )?what i\b", r"\bnot something i (?:can|am|may)\b", r"\bno answer can be given\b", r"\bnot (?:contain|include|provide) enough (?:information|context|detail)", r"\bunable to (?:answer|determine|help|assist|say|comment|provide)", r"\bcan(?:no|['’])t (?:answer|help with|assist)\b", r"\b(?:i ['’]?d|i would) rather not\b", r"\bbeyond (?:my|the scope)\b", r"\boutside (?:of )?(?:my|the scope)\b",
            r"\bals (?:ki-?)?(?:sprachmodell|ki|assistent)\b", r"\bich (?:kann|darf|möchte|will|werde)\b.{0,60}\b(?:nicht|keine?)\b.{0,40}\b(?:beantworten|helfen|sagen|antworten|geben|auskunft|weiterhelfen|beurteilen)", r"\b(?:tut mir leid|es tut mir|leider (?:kann|darf|ist es mir|habe) ?(?:ich)?)\b", r"\bich habe keinen zugriff\b", r"\bkeinen zugriff auf\b", r"\bdazu (?:kann|darf) ich\b", r"\bentschuldigung\b",
            r"\bje (?:suis désolé|regrette|ne peux pas|ne suis pas|n['’]ai pas (?:accès|assez|le droit)|ne sais pas|dois refuser|ne puis)", r"\ben tant que modèle\b", r"\bdésolée?\b", r"\bmalheureusement\b.{0,40}\bje\b", r"\b(?:m['’]est|est) impossible de répondre", r"\bil ne m['’]est pas possible",
            r"\blo siento\b", r"\bno (?:puedo|tengo acceso|tengo suficiente|me es posible|sé)\b.{0,60}", r"\bcomo modelo de lenguaje\b", r"\blamento\b.{0,20}\bno\b", r"\blamentablemente\b", r"\bno estoy autorizad",
            r"\bnon posso (?:rispondere|aiutare)", r"\bmi dispiace\b", r"\bnão posso (?:responder|ajudar)", r"\bdesculpe\b", r"\bhet spijt me\b", r"\bк сожалению\b", r"\bя не могу\b", r"\bизвините\b", r"抱歉|对不起|無法回答|无法回答|不能回答|申し訳|お答えできません",
        ]
    ),
    re.I,
)
PLEASANTRY = re.compile(r"^(good|great|nice|interesting|excellent) question|^thanks?( you)?( for asking)?\W*$|^(hi|hello|hallo|bonjour|hola)\b[^.]{0,20}$|^(gute frage|bonne question|buena pregunta)", re.I)
SEED_ANSWERS = ["The limit is read once and applied to the list.", "It returns `None` when nothing matches.", "Never.", "In `load_table`.", "Call it like this:\n```python\nload(rows)\n```", "Der Wert wird einmal gelesen und dann verwendet.", "La valeur est lue une seule fois.", "El valor se lee una sola vez.", "Значение читается один раз.", "该值只读取一次。", "It prints \"done\".", "The entry point is `main()`", "Only twice (see the note)."]


def bare(text: str) -> str:
    """Letters and digits in small print, other characters as one blank."""
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


def extra_bytes(answer: str, question: str) -> tuple[int, int]:
    """Size of the bare answer compressed with the bare question as dictionary, and without one."""
    a, q = bare(answer).encode(), bare(question).encode()
    params = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    plain = len(zstandard.ZstdCompressor(compression_params=params).compress(a))
    if len(q) < 8:
        return plain, plain
    known = zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(a)), plain


def is_copy(answer: str, question: str) -> bool:
    a, q = bare(answer), bare(question)
    if not a or not q:
        return False
    if a == q:
        return True
    with_q, plain = extra_bytes(answer, question)
    # A copy costs a few bytes for its matches; a restated question with an answer costs the answer.
    return len(a) >= 0.6 * len(q) and with_q <= 24 + 0.02 * len(a.encode()) and with_q < 0.6 * plain and not adds_words(a, q)


def adds_words(a: str, q: str) -> bool:
    """Whether the answer has words that the question lacks, besides a lead-in of at most three."""
    known = set(q.split())
    fresh = [w not in known for w in a.split()]
    lead = fresh.index(False) if False in fresh else len(fresh)
    return lead > 3 or any(fresh[lead:])


def prose(text: str) -> str:
    return re.sub(r"```.*?(```|$)|`[^`]*`|\"[^\"]*\"|«[^»]*»|„[^“”]*[“”]|“[^”]*”|\w+\.\w{1,5}\b|\w*_\w+|\w+\(\)", " ", text, flags=re.S)


def language(text: str) -> tuple[str, int]:
    """The language or script of a text and how many words speak for it over the next one."""
    text = prose(text)
    scripts = Counter()
    for c in text:
        if c.isalpha():
            o = ord(c)
            s = "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "cyrillic" if 0x400 <= o < 0x530 else "greek" if 0x370 <= o < 0x400 else "arabic" if 0x600 <= o < 0x780 else "hebrew" if 0x590 <= o < 0x600 else "deva" if 0x900 <= o < 0x980 else "thai" if 0xE00 <= o < 0xE80 else "kana" if 0x3040 <= o < 0x3100 else "hangul" if 0xAC00 <= o < 0xD7B0 else "han" if 0x3400 <= o < 0xA000 else "other"
            scripts[s] += 4 if s in ("han", "kana", "hangul") else 1
    if not scripts:
        return "", 0
    top = scripts.most_common(1)[0][0]
    if top in ("han", "kana") and scripts["kana"] > 0.1 * scripts["han"]:
        return "kana", 9
    if top != "latin":
        return top, 9 if scripts[top] >= 8 else 0
    words = re.findall(r"[^\W\d_]+['’]?", text.lower().replace("’", "'"))
    hits = Counter({k: sum(w in v for w in words) for k, v in COMMON.items()})
    (best, n), (_, m) = hits.most_common(2)
    return best, n - m


def other_language(answer: str, question: str) -> bool:
    a, na = language(answer)
    q, nq = language(question)
    return bool(a and q and a != q and na >= 3 and nq >= 1)


def is_refusal(answer: str) -> bool:
    """Whether the first thing the answer says, after any pleasantry, declines to answer."""
    parts = [p for p in re.split(r"(?<=[.!?。])\s+|\n+", answer.strip()) if p.strip()]
    while len(parts) > 1 and PLEASANTRY.search(parts[0].strip()):
        parts.pop(0)
    return bool(parts) and bool(REFUSAL.search(parts[0].replace("’", "'")))


def is_empty(answer: str | None) -> bool:
    """Nothing but blanks, marks, an empty code block or a filler."""
    if answer is None:
        return True
    a = "".join(c for c in answer if unicodedata.category(c) not in ("Cf", "Cc", "Zs") or c in " \n\t")
    a = re.sub(r"```\w*\s*```", "", a)
    flat = re.sub(r"[\W_]+", " ", a).strip()
    return not flat or bool(FILLER.fullmatch(flat))


def ending(text: str) -> list[int]:
    """Hashed features of how a text ends."""
    t = text.rstrip()
    body = t.rstrip("*_")

    def c(x: str) -> str:
        return "end" if x in ".!?。！？…؟।" else "q" if x in "\"'”’»“」』" else "b" if x in ")]}）" else "o" if x in "([{（" else "tick" if x == "`" else "," if x in ",;、，；" else ":" if x in ":：" else "d" if x.isdigit() else "a" if x.isalpha() else "-"

    last, prev = c(body[-1:]) if body else "-", c(body[-2:-1]) if len(body) > 1 else "-"
    fences = t.count("```")
    inline = re.sub(r"```.*?(```|$)", "", t, flags=re.S)
    opened = sum(inline.count(x) for x in "([{") > sum(inline.count(x) for x in ")]}")
    tail = re.split(r"[.!?。！？]\s", t)[-1]
    word = (re.findall(r"[\w']+", t) or [""])[-1].lower()
    common = any(word in v for v in COMMON.values())
    names = [
        "bias", f"l={last}", f"pl={prev}{last}", f"fence={fences % 2}", f"fence={fences % 2}{last}", f"tick={inline.count('`') % 2}", f"open={opened}", f"closed={last == 'tick' and inline.count('`') % 2 == 0}", f"common={common}{last}", f"many={bool(re.search(r'[.!?。]', t[:-1]))}{last}",
        f"tail={min(4, len(tail.split()) // 3)}{last}", f"len={min(3, len(t.split()) // 4)}{last}", f"fenced={t.endswith('```')}",
    ]
    return [zlib.crc32(n.encode()) % 4096 for n in names]


def fit_ending(answers: list[str], rounds: int = 300) -> np.ndarray:
    """Weights by which a text seems cut short: whole answers against the same cut at a place drawn from their hash."""
    rows, y = [], []
    for a in [*answers, *SEED_ANSWERS * max(1, len(answers) // 50)]:
        t = a.strip()
        if len(t) < 2:
            continue
        if t.count("```") % 2 == 0:  # an open code block is no example of a whole response
            rows.append(ending(t))
            y.append(0.0)
        places = [1 + zlib.crc32(t.encode()) % (len(t) - 1)]
        if "```" in t:  # and one cut within the code
            first = t.index("```") + 3
            places.append(first + zlib.crc32(t.encode()) % max(1, len(t) - first - 3))
        for place in places:
            cut = t[:place].rstrip()
            if cut and (cut[-1] not in ".!?。！？`" or cut.count("```") % 2):
                rows.append(ending(cut))
                y.append(1.0)
    x, y = np.array(rows), np.array(y)
    w, v = np.zeros(4096), np.full(4096, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-w[x].sum(1)))
        g = np.bincount(x.ravel(), np.repeat(p - y, x.shape[1]), 4096) / len(y) + 1e-5 * w
        v += g * g
        w -= 0.5 * g / np.sqrt(v)
    return w


def defect(question: str | None, answer: str | None, weights: np.ndarray) -> str | None:
    if is_empty(answer):
        return "empty"
    q = question or ""
    if is_copy(answer, q):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if other_language(answer, q):
        return "language"
    if weights[ending(answer)].sum() > 0:
        return "truncated"
    return None


def defective_pairs(df: DataFrame, id_col: str = "qa_id", question: str = "question", answer: str = "ground_truth_answer") -> DataFrame:
    """Pairs that cannot serve, with their defect.

    Result: ``<id_col>, defect``, one row per defective pair; ``defect`` is ``empty``,
    ``copy``, ``refusal``, ``language`` or ``truncated``, the first that holds. A null
    answer is empty, a null question has no language and no copy. Null ids are left
    out, of a repeated id one row counts, other columns are not read, no rows give
    no result.
    """
    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a"))
    picked = src.where((F.length(F.trim("a")) > 1) & (F.length("a") <= SAMPLE_CHARS)).select("a").orderBy(F.xxhash64("a"), "a").limit(SAMPLE_ROWS)
    weights = df.sparkSession.sparkContext.broadcast(fit_ending(sorted(r[0] for r in picked.collect())))

    def judge(q: pd.Series, a: pd.Series) -> pd.Series:
        w = weights.value
        return pd.Series([defect(x if isinstance(x, str) else None, y if isinstance(y, str) else None, w) for x, y in zip(q, a, strict=True)], dtype="object")

    judged = src.select(id_col, F.pandas_udf(judge, "string")("q", "a").alias("defect"))
    return judged.where("defect is not null").groupBy(id_col).agg(F.min("defect").alias("defect"))
