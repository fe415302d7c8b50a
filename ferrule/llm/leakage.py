"""Evaluation texts leaking into training text (problem 9).

Texts become sequences of normalised words, documents become passages (windows of
words). A distributed randomised SVD of the passages' TF-IDF matrix, over all
documents and the words of the items, gives a latent space; a passage and a piece
of an item that lie close there make document and item a candidate. A candidate is
then read word by word: its longest common run decides a copied passage, its
longest common subsequence with the item (and the item's answer, if there is one,
standing in the document) a paraphrase.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import checkpoint, spread

TAG = re.compile(r"<!--|-->|</?[a-zA-Z][^<>]{0,200}>")
LINK = re.compile(r"\]\([^()\s]*\)")
WORD = re.compile(r"[^\W_]+")
#: Characters and distinct words of the items handled at once, at most; more items are taken in blocks.
BLOCK_CHARS, BLOCK_WORDS = 8_000_000, 50_000
#: Bytes of a sum that one row holds; longer ones are summed slice by slice.
SLICE_BYTES = 4_000_000


def words(text: str) -> list[str]:
    """Words without case, accents, punctuation, markup and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = LINK.sub(" ", text)
    if "<" in text:
        text = TAG.sub("", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    return WORD.findall(text.casefold().replace("'", "").replace("’", ""))


def windows(n: int, width: int, step: int) -> np.ndarray:
    """Starts and ends of windows that cover ``n`` words."""
    if n <= width:
        return np.array([[0, n]])
    starts = np.unique(np.minimum(np.arange(0, n - width + step, step), n - width))
    return np.stack([starts, starts + width], 1)


def window_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)])
    return c[at[:, 1]] - c[at[:, 0]]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of it at a time as the bits of one integer."""
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a.tolist()):
        where[x] |= 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b.tolist():
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of words that both have."""
    where = defaultdict(list)
    for j, x in enumerate(b.tolist()):
        where[x].append(j)
    best, before = 0, {}
    for x in a.tolist():
        now = {j: before.get(j - 1, 0) + 1 for j in where.get(x, ())}
        best, before = max([best, *now.values()]), now
    return best


def words_in_common(a: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> int:
    """At most so long is a common subsequence: ``a``'s distinct words and their numbers against ``b``'s words."""
    distinct, count = a
    at = np.minimum(np.searchsorted(distinct, b), len(distinct) - 1)
    return int(np.minimum(count, np.bincount(at[distinct[at] == b], minlength=len(distinct))).sum()) if len(distinct) else 0


def among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Those of ``keys`` that occur in an ordered array."""
    return keys[ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys] if len(ordered) else keys[:0]


def run_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of every run of ``n`` words."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[i : i + len(h)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return h


def summed(parts: DataFrame) -> np.ndarray | None:
    """Sum of the float32 arrays that tasks gave in slices (``part, slice, data``): per group of tasks, then of all.

    Both steps are shuffles by slice; only the one sum reaches the driver.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in pdf["data"])
        return pd.DataFrame({"part": [0], "slice": pdf["slice"].iloc[:1], "data": [total.tobytes()]})

    shape = "part long, slice long, data binary"
    got = parts.groupBy("part", "slice").applyInPandas(add, shape).groupBy("slice").applyInPandas(add, shape).collect()
    return np.concatenate([np.frombuffer(bytes(r["data"]), np.float64) for r in sorted(got, key=lambda r: r["slice"])]) if got else None


def slices(total: np.ndarray, part: int) -> pa.RecordBatch:
    """A task's sum as rows for ``summed``."""
    flat, step = np.ascontiguousarray(total, np.float64).ravel(), SLICE_BYTES // 8
    cut = [flat[i : i + step].tobytes() for i in range(0, len(flat), step)]
    return pa.RecordBatch.from_pydict({"part": [part] * len(cut), "slice": list(range(len(cut))), "data": cut}, schema=pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("data", pa.binary())]))


def passages(starts: np.ndarray, width: int) -> np.ndarray:
    """Of every word the number of its passage, where documents (from ``starts`` on, with the end) are cut every ``width`` words."""
    n = np.diff(starts)
    first = np.concatenate([[0], np.cumsum(-(-n // width))])[:-1]
    doc = np.repeat(np.arange(len(n)), n)
    return first[doc] + (np.arange(starts[-1]) - starts[:-1][doc]) // width


def document_counts(got: np.ndarray | None, ids: np.ndarray, passage: np.ndarray, size: int) -> np.ndarray:
    """Adds to ``got`` the number of passages that hold each word."""
    pairs = np.unique(passage * (size + 1) + ids)
    return (np.zeros(size + 1) if got is None else got) + np.bincount(pairs % (size + 1), minlength=size + 1)


def covariance_times(got: np.ndarray | None, ids: np.ndarray, passage: np.ndarray, weights: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Adds to ``got`` A' A ``weights`` for the passages' rows A, each of unit length."""
    got = np.zeros(weights.shape) if got is None else got
    known = np.flatnonzero(squares[ids] > 0)  # only words with weight count
    if not len(known):
        return got
    ids, passage = ids[known], passage[known]
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    y = np.add.reduceat(weights[ids], first, axis=0) / np.add.reduceat(squares[ids], first)[:, None]
    order = np.argsort(ids, kind="stable")
    rows, begin = np.unique(ids[order], return_index=True)
    got[rows] += np.add.reduceat(y[row[order]], begin, axis=0)
    return got


class Cells:
    """Inverted lists over unit vectors: each lies in the cell of its nearest centre, searches read the nearest cells.

    As many cells as the root of the number of vectors, so a search costs the centres and ``share`` of the vectors.
    """

    def __init__(self, vectors: np.ndarray, owner: np.ndarray, share: float, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        n = max(1, round(len(vectors) ** 0.5))
        self.centers = vectors[rng.choice(len(vectors), n, replace=False)]
        for _ in range(8):
            cell = self._nearest(vectors)
            sums = np.zeros_like(self.centers)
            np.add.at(sums, cell, vectors)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centers = np.where(length > 0, sums / np.maximum(length, 1e-9), self.centers).astype(np.float32)
        cell = self._nearest(vectors)
        self.members = [np.flatnonzero(cell == c) for c in range(n)]
        self.vectors = [np.ascontiguousarray(vectors[m].T) for m in self.members]
        self.owner = [owner[m] for m in self.members]
        self.probes = max(1, math.ceil(n * share))

    def _nearest(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([(vectors[i : i + 4096] @ self.centers.T).argmax(1) for i in range(0, len(vectors), 4096)])

    def near(self, p: np.ndarray, closeness: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``p`` and owners of the vectors with a cosine of ``closeness`` or more, as found in the cells read."""
        at = np.argpartition(-(p @ self.centers.T), self.probes - 1, axis=1)[:, : self.probes]
        order = np.argsort(at.ravel(), kind="stable")
        cell = at.ravel()[order]
        row = order // self.probes
        bounds = np.searchsorted(cell, np.arange(len(self.centers) + 1))
        rows, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < z and len(self.owner[c]):
                r, v = np.nonzero(p[row[a:z]] @ self.vectors[c] >= closeness)
                rows.append(row[a:z][r])
                owners.append(self.owner[c][v])
        return np.concatenate(rows), np.concatenate(owners)


def item_blocks(items: DataFrame) -> Iterator[list]:
    """The items in lists within ``BLOCK_CHARS`` and ``BLOCK_WORDS`` (a single longer item stands alone)."""
    block, chars, seen = [], 0, set()
    for r in items.toLocalIterator():
        mine = {w for t in (r["text"], r["answer"]) if t for w in words(t)}
        size = len(r["text"]) + len(r["answer"] or "")
        if block and (chars + size > BLOCK_CHARS or len(seen | mine) > BLOCK_WORDS):
            yield block
            block, chars, seen = [], 0, set()
        block.append(r)
        chars, seen = chars + size, seen | mine if block[1:] else mine
    yield block


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", answer: str | None = None, min_run: int = 12, rank: int = 128, closeness: float = 0.65, paraphrase: float = 0.75, known_share: float = 2 / 3, cell_share: float = 0.2) -> DataFrame:
    """Documents that repeat a passage of an item, and the items.

    Result: ``doc_id, item_id, kind, run, common``; ``run`` is the longest common run
    of words (0 below ``min_run``), ``common`` the share of the item's words in its
    longest common subsequence with that part of the document. ``kind`` is ``run``
    from ``min_run`` words on, else ``paraphrase`` when ``common`` reaches
    ``paraphrase`` and the item's ``answer``, where given, stands in the document.
    A passage is compared if ``known_share`` of its words occur in items (a copied
    run of ``min_run`` words always reaches the default) and meets the pieces of
    ``cell_share`` of the latent cells, those nearest to it. Of a repeated doc_id or
    item_id one row counts; null ids and texts give nothing;
    an item of fewer than ``min_run`` words can only be paraphrased; no items or no
    documents give an empty result. Other columns are not read.
    """
    items = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer")).dropDuplicates(["item_id"])
    out = None
    for mine in item_blocks(items):
        part = _leaked_block(docs, mine, items.schema["item_id"].dataType.simpleString(), doc_id, text, min_run, rank, closeness, paraphrase, known_share, cell_share)
        out = part if out is None else out.unionByName(part)
    return out


def _leaked_block(docs: DataFrame, items: list, item_type: str, doc_id: str, text: str, min_run: int, rank: int, closeness: float, paraphrase: float, known_share: float, cell_share: float) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    # With these widths and steps any run of min_run words lies whole within a window of either side.
    width, step, item_width, item_step = min_run * 3 // 2, min_run // 2 + 1, min_run + 3, 4
    vocabulary: dict[str, int] = {}
    item_words = [words(r["text"]) for r in items]
    answers = [words(r["answer"]) if r["answer"] else [] for r in items]
    for ws in [*item_words, *answers]:
        for w in ws:
            vocabulary.setdefault(w, len(vocabulary))
    size = len(vocabulary)
    known = sc.broadcast(vocabulary)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in it:
            ids = [np.array([get(w, size) for w in words(t)], np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() if (x < size).any() else b"" for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    src = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    read_docs = checkpoint(spread(src, "doc_id").mapInArrow(read, f"doc_id {kind_of_id}, n long, ids binary").dropDuplicates(["doc_id"]))
    texts = read_docs.where(F.length("ids") > 0).select("doc_id", "ids")

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Documents of about 50,000 words at a time: their ids, where each begins (and the end), all words."""
        names, parts, starts, n = [], [], [], 0
        for b in it:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(x, np.int32)
                names.append(d)
                parts.append(ids)
                starts.append(n)
                n += len(ids)
                if n >= 50_000:
                    yield names, np.array([*starts, n]), np.concatenate(parts)
                    names, parts, starts, n = [], [], [], 0
        if n:
            yield names, np.array([*starts, n]), np.concatenate(parts)

    def task_sum(make):
        """A mapInArrow function that gives the sum of ``make`` over a task's documents."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            got = None
            for _, starts, ids in groups(it):
                got = make(got, ids, passages(starts, width))
            if got is not None:
                yield slices(got, TaskContext.get().partitionId() % 64)

        return run

    shape = "part long, slice long, data binary"
    df = summed(texts.mapInArrow(task_sum(lambda got, ids, passage: document_counts(got, ids, passage, size)), shape))
    n = read_docs.agg(F.sum(F.ceil(F.col("n") / width))).first()[0] or 0
    idf = np.log(1 + n / (1 + (df if df is not None else np.zeros(size + 1)))).astype(np.float32)
    idf[size] = 0
    rng = np.random.default_rng(5)
    rank = min(rank, size)
    basis = np.linalg.qr(rng.normal(size=(size, min(size, rank + 10))))[0]
    for _ in range(2):  # passes of the randomised SVD over all passages: basis <- orth(A' A basis)
        weights = sc.broadcast((np.vstack([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32) * idf[:, None], idf**2))
        z = summed(texts.mapInArrow(task_sum(lambda got, ids, passage, held=weights: covariance_times(got, ids, passage, *held.value)), shape))
        if z is None:
            break
        basis = np.linalg.qr(z.reshape(size + 1, -1)[:size] * idf[:size, None])[0]
    latent = (np.vstack([basis[:, :rank], np.zeros((1, rank))]) * idf[:, None]).astype(np.float32)

    def pieces() -> tuple[np.ndarray, np.ndarray]:
        vectors, owner = [np.zeros((0, rank), np.float32)], []
        for i, ws in enumerate(item_ids):
            if len(ws):
                vectors.append(window_sums(latent[ws], windows(len(ws), item_width, item_step)))
                owner += [i] * len(vectors[-1])
        v = np.concatenate(vectors)
        return (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)).astype(np.float32), np.array(owner, np.int64)

    item_ids = [np.array([vocabulary[w] for w in ws], np.int32) for ws in item_words]
    answer_ids = [np.array([vocabulary[w] for w in ws], np.int32) for ws in answers]
    piece_vectors, owner = pieces()
    cells = Cells(piece_vectors, owner, cell_share) if len(owner) else None
    held = sc.broadcast((latent, cells, item_ids, answer_ids, [r["item_id"] for r in items]))

    def match(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, cells, item_ids, answer_ids, names = held.value
        runs = [np.sort(run_keys(x, min_run)) for x in item_ids]
        every_run = np.unique(np.concatenate([np.zeros(0, np.uint64), *runs]))
        counts = [np.unique(x, return_counts=True) for x in item_ids]
        for docs_, starts, all_ids in groups(it):
            rows: dict[str, list] = {"doc_id": [], "item_id": [], "kind": [], "run": [], "common": []}
            at = np.concatenate([windows(int(n), width, step) + a for a, n in zip(starts, np.diff(starts), strict=False)])
            doc_of = np.searchsorted(starts, at[:, 0], side="right") - 1
            enough = np.minimum(width, np.diff(starts)[doc_of]) * known_share
            keep = window_sums((all_ids < size)[:, None], at)[:, 0] >= enough - 1e-9
            at, doc_of = at[keep], doc_of[keep]
            near: dict[tuple[int, int], list] = {}
            for k in range(0, len(at) if cells else 0, 2048):
                place = at[k : k + 2048, :1] + np.arange(width)
                p = latent[np.where(place < at[k : k + 2048, 1:], all_ids[np.minimum(place, len(all_ids) - 1)], size)].sum(1)
                p /= np.linalg.norm(p, axis=1, keepdims=True) + 1e-9
                r, c = cells.near(p, closeness)
                if not len(r):
                    continue
                pair = doc_of[k + r] * len(item_ids) + c
                order = np.argsort(pair, kind="stable")
                keys, first = np.unique(pair[order], return_index=True)
                lo, hi = np.minimum.reduceat(at[k + r, 0][order], first), np.maximum.reduceat(at[k + r, 1][order], first)
                for key, a, z in zip(keys.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    seen = near.setdefault((key // len(item_ids), key % len(item_ids)), [a, z])
                    seen[0], seen[1] = min(seen[0], a), max(seen[1], z)
            runs_of: dict[int, np.ndarray] = {}
            for (o, i), (first_, last_) in near.items():
                ids = all_ids[starts[o] : starts[o + 1]]
                if o not in runs_of:
                    runs_of = {o: among(run_keys(ids, min_run), every_run)}
                item = item_ids[i]
                seg = ids[max(0, first_ - starts[o] - len(item)) : last_ - starts[o] + len(item)]
                run = longest_run(item, ids) if len(among(runs_of[o], runs[i])) else 0
                if run < min_run and words_in_common(counts[i], seg) < paraphrase * len(item):
                    continue
                common = common_subsequence(item, seg) / max(1, len(item))
                answered = not len(answer_ids[i]) or longest_run(answer_ids[i], ids) == len(answer_ids[i])
                kind = "run" if run >= min_run else "paraphrase" if common >= paraphrase and answered else None
                if kind:
                    for k, v in zip(rows, (docs_[o], names[i], kind, run, common), strict=True):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.int64() if kind_of_id == "bigint" else pa.string()), ("item_id", pa.int64() if item_type == "bigint" else pa.string()), ("kind", pa.string()), ("run", pa.int64()), ("common", pa.float64())])
    return texts.mapInArrow(match, f"doc_id {kind_of_id}, item_id {item_type}, kind string, run long, common double")
