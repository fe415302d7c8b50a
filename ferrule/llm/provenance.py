"""Generated, minified or vendored source files (problem 5).

Belief propagation over the directory trees of the repositories. A file's content
and name give evidence for the labels handwritten, generated, minified, vendored and
blob; a directory's name gives evidence too; compatibilities between a directory and
what lies in it carry evidence between parents and siblings. The graph is a tree, so
one pass from the leaves to the roots and one back give the exact marginals. Each
pass goes level by level; a level is one aggregation of messages by directory, in
which the messages of a large directory are added up before they are shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import checkpoint, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
# Names of directories that hold other projects' code, tool output or bundles.
VENDOR_DIRS = set("vendor _vendor vendored .vendor third_party third-party thirdparty 3rdparty 3rd_party 3rd-party external externals extern _external deps _deps node_modules bower_components jspm_packages site-packages dist-packages contrib-vendor vendor_libs".split())
GENERATED_DIRS = set("gen generated _generated __generated__ autogen auto_generated generated-sources generated_src pb proto_gen stubs_gen".split())
BUNDLE_DIRS = set("dist min minified bundles".split())
# Marks of tools and of upstream projects in head comments, and names of files that tools write.
TOOL_MARK = re.compile(
    r"auto[- ]?generated|@generated\b|<auto-?generated|code generated by|\bgenerated (?:by|from|with|using|on|at|\d{4})|\bdo not (?:edit|modify)|automatically (?:created|generated|produced)|(?:changes|edits)(?: made)? by hand|will be (?:lost|overwritten)|regenerate with|this file (?:is|was) (?:created|produced|written) by|machine[- ]generated|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:bearbeiten|ändern)|généré automatiquement|ne pas modifier|generado automáticamente|no (?:editar|modificar)|автоматически создан",
    re.I,
)
UPSTREAM_MARK = re.compile(r"\bupstream\b|imported unchanged|vendored (?:from|copy)|copied (?:verbatim )?from|\b[\w.-]+ (?:- )?(?:version |v|release )\d+\.\d+(?:\.\d+)?\b|(?:\(c\)|©|copyright).{0,40}\b(?:contributors|authors|developers|foundation)\b|see the notice file", re.I)
LICENSE_MARK = re.compile(r"\b(?:released|licensed|distributed) under|spdx-license-identifier|permission is hereby granted|\bmit license\b|apache license|bsd license", re.I)
TOOL_NAME = re.compile(r"(?:_pb2(?:_grpc)?|\.pb|\.generated|\.gen|_generated|\.g|\.designer|_pb|\.auto)(?:[._-][a-z0-9]+)?\.\w+$", re.I)
MIN_NAME = re.compile(r"[.-]min\.\w+$|\.bundle\.\w+$|[-.]bundle\.js$", re.I)
STRING = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|`[^`]*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
COMMENT = re.compile(r"/\*[\s\S]*?\*/|^[ \t]*(?:#|//).*$", re.M)
NUMBER = re.compile(r"\b0x[0-9a-fA-F]+|\d[\w.]*")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")


def head_comment(text: str) -> str:
    """The comments before the first line of code."""
    out, inside = [], False
    for line in text.split("\n"):
        s = line.strip()
        if inside:
            out.append(s)
            inside = "*/" not in s
        elif s.startswith("/*"):
            out.append(s)
            inside = "*/" not in s
        elif s.startswith(("#", "//", "<!--")):
            out.append(s)
        elif s and s not in ('"use strict";', "'use strict';"):
            break
    return "\n".join(out)


def evidence(path: str, text: str, source: bool = True) -> list[float]:
    """Log-likelihoods of the labels from a file's name and content, up to a constant; what is no ``source`` is judged by its name and head."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    hand = generated = minified = vendored = blob = 0.0
    head, name = head_comment(text), path.rsplit("/", 1)[-1]
    vendored -= 1.2  # such files seldom lack every mark
    generated -= 3.0
    minified -= 7.0
    blob -= 7.0
    if TOOL_MARK.search(head):
        generated += 11.0
    if TOOL_NAME.search(name):
        generated += 8.0
    if UPSTREAM_MARK.search(head):
        vendored += 9.0
    if LICENSE_MARK.search(head):
        vendored += 2.0
    if MIN_NAME.search(name):
        minified += 5.0
    if not source:
        return [hand, generated, minified, vendored, blob]
    body = COMMENT.sub("", text)
    bare = STRING.sub('""', body)
    dense = max(1, len(re.sub(r"\s", "", body)))
    lines = [line for line in text.split("\n") if line.strip()]
    code = sum(map(len, IDENTIFIER.findall(NUMBER.sub("0", bare)))) / dense
    long_share = sum(len(x) for x in lines if len(x) > 250) / max(1, len(text))
    blanks = len(re.findall(r"\s", body)) / max(1, len(body))
    shapes = [re.sub(r"\d+", "0", IDENTIFIER.sub("w", STRING.sub('""', x.strip()))) for x in body.split("\n") if x.strip()]
    variety = len(set(shapes)) / max(1, len(shapes))
    if len(shapes) >= 8 and code >= 0.06:
        generated += 9.0 if variety < 0.2 else 5.0 if variety < 0.28 else -0.5
        hand += 0.5 if variety > 0.4 else 0.0
    if re.search(r"__awaiter|__importDefault|_serialized_start|_descriptor_pool|descriptor_pool|__typename|_lr_action|\bparser_tables\b", text):
        generated += 8.0
    if len(body) > 200 and code >= 0.06:
        if long_share > 0.5 and blanks < 0.14:
            minified += 17.0
        elif blanks < 0.09 and sum(map(len, lines)) / max(1, len(lines)) > 120:
            minified += 14.0
        elif long_share > 0.5:
            minified += 3.0
    if len(body) > 250 and code < 0.06:
        blob += 17.0
    elif len(body) > 2000 and code < 0.12:
        blob += 8.0
    return [hand, generated, minified, vendored, blob]


def dir_evidence(name: str) -> list[float]:
    """Log-likelihoods of the labels from a directory's own name."""
    n = name.lower()
    out = [0.0] * 5
    if not n:  # a root
        return [0.0, -3.0, -3.0, -3.0, -3.0]
    if n in VENDOR_DIRS:
        out[3] += 13.0
    elif re.search(r"^[a-z][\w-]*[-_@]v?\d+\.\d+(\.\d+)*$", n):  # a library with its version
        out[3] += 11.0
    elif n in GENERATED_DIRS:
        out[1] += 4.0
    elif n in BUNDLE_DIRS:
        out[2] += 3.0
    return out


#: log P(label of what lies in a directory | label of the directory): of files, of directories.
FILE_IN_DIR = [[math.log(p) for p in row] for row in ([0.955, 0.10, 0.15, 0.01, 0.15], [0.012, 0.86, 0.02, 0.02, 0.02], [0.008, 0.01, 0.79, 0.02, 0.01], [0.017, 0.02, 0.03, 0.94, 0.02], [0.008, 0.01, 0.01, 0.01, 0.80])]
DIR_IN_DIR = [[math.log(p) for p in row] for row in ([0.964, 0.08, 0.08, 0.01, 0.08], [0.010, 0.89, 0.01, 0.005, 0.01], [0.008, 0.01, 0.89, 0.005, 0.01], [0.010, 0.01, 0.01, 0.975, 0.01], [0.008, 0.01, 0.01, 0.005, 0.89])]


def log_sum(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def messages(table: list[list[float]], down: bool, cols: list[Column]) -> Column:
    """A struct ``m0 .. m4``: the message through a table to the directory's labels, or ``down`` to those of what lies in it."""
    step = np.array(table) if down else np.array(table).T  # [to, from]

    def send(*labels: pd.Series) -> pd.DataFrame:
        x = np.stack([s.to_numpy(np.float64) for s in labels], 1)
        return pd.DataFrame(log_sum(x[:, None, :] + step[None]), columns=[f"m{i}" for i in range(len(step))])

    return F.pandas_udf(send, ", ".join(f"m{i} double" for i in range(len(step))))(*cols)


def label_files(files: DataFrame, id_col: str = "file_id", repo: str = "repo_name", path: str = "path", content: str = "content", language: str | None = None) -> DataFrame:
    """The label of every file and how sure it is.

    Result: ``<id_col>, label, confidence``, with ``language`` where that is given, one row per id; ``confidence``
    is the marginal probability of the label. Null ids are left out; a null content or
    path counts as empty, a null repo as a repository of its own; of a repeated id one
    row counts; other columns are not read. An empty table gives an empty result. Where
    ``language`` is given, files of no known one (null or ``unknown``) take part with
    their names and head marks; what the shape of code says is not asked of them.
    """
    k = range(len(LABELS))
    kept = [F.col("lang").alias(language)] if language else []
    kind = files.schema[id_col].dataType.simpleString()
    src = files.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(repo), F.lit("")).alias("repo"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"), (F.col(language) if language else F.lit("source")).cast("string").alias("lang"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ev = [evidence(p, t, lang not in (None, "unknown")) for p, t, lang in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), *(pa.array([e[i] for e in ev], pa.float64()) for i in k)], ["id", "repo", "path", "lang", *(f"e{i}" for i in k)])

    ev = spread(src, "id").mapInArrow(run, f"id {kind}, repo string, path string, lang string, " + ", ".join(f"e{i} double" for i in k)).dropDuplicates(["id"])
    trail = F.split(F.regexp_replace("path", r"^/+|//+", "/"), "/")
    ev = ev.withColumn("dirs", F.slice(trail, 1, F.greatest(F.size(trail) - 1, F.lit(0)))).withColumn("dir", F.concat_ws("/", "dirs")).withColumn("depth", F.size("dirs"))
    ev = ev.withColumn("m", messages(FILE_IN_DIR, False, [F.col(f"e{i}") for i in k]))
    ev = checkpoint(ev.select("id", "repo", "lang", "dir", "depth", *(f"e{i}" for i in k), *(f"m.m{i}" for i in k)))
    # Every directory on the way to a file, with what the files in it and its name say.
    leaf = ev.groupBy("repo", "dir", "depth").agg(*(F.sum(f"m{i}").alias(f"s{i}") for i in k))
    up = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), F.lit(1), d), "/").alias("dir")))
    nodes = leaf.select("repo", F.explode(up).alias("x")).select("repo", "x.dir", "x.depth").distinct()

    def named(dirs: pd.Series) -> pd.Series:
        return dirs.map(lambda d: dir_evidence(d.rsplit("/", 1)[-1]))

    nodes = nodes.withColumn("own", F.pandas_udf(named, "array<double>")("dir")).join(leaf, ["repo", "dir", "depth"], "left")
    nodes = checkpoint(nodes.select("repo", "dir", "depth", *((F.element_at("own", i + 1) + F.coalesce(f"s{i}", F.lit(0.0))).alias(f"s{i}") for i in k)))
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return ev.select(F.col("id").alias(id_col), *kept, F.lit("").alias("label"), F.lit(0.0).alias("confidence"))
    parent = F.regexp_replace("dir", r"/?[^/]*$", "")
    levels: dict[int, DataFrame] = {}
    below = None
    for d in range(deepest, -1, -1):  # to the roots
        at = nodes.where(F.col("depth") == d)
        if below is not None:
            at = at.join(below, ["repo", "dir"], "left").select("repo", "dir", "depth", *((F.col(f"s{i}") + F.coalesce(f"c{i}", F.lit(0.0))).alias(f"s{i}") for i in k))
        at = at.withColumn("m", messages(DIR_IN_DIR, False, [F.col(f"s{i}") for i in k]))
        levels[d] = at = checkpoint(at.select("repo", "dir", parent.alias("parent"), *(f"s{i}" for i in k), *(F.col(f"m.m{i}").alias(f"u{i}") for i in k)))
        below = at.groupBy("repo", F.col("parent").alias("dir")).agg(*(F.sum(f"u{i}").alias(f"c{i}") for i in k))
    beliefs = {0: levels[0].select("repo", "dir", *(F.col(f"s{i}").alias(f"b{i}") for i in k))}
    for d in range(1, deepest + 1):  # and back
        above = beliefs[d - 1].select("repo", F.col("dir").alias("parent"), *(F.col(f"b{i}").alias(f"p{i}") for i in k))
        at = levels[d].join(above, ["repo", "parent"])
        at = at.withColumn("m", messages(DIR_IN_DIR, True, [F.col(f"p{i}") - F.col(f"u{i}") for i in k]))
        beliefs[d] = checkpoint(at.select("repo", "dir", *((F.col(f"s{i}") + F.col(f"m.m{i}")).alias(f"b{i}") for i in k)))
    all_dirs = reduce(DataFrame.unionByName, beliefs.values())

    def decide(*cols: pd.Series) -> pd.DataFrame:
        """Label and marginal from a file's evidence, its own message and its directory's belief."""
        e, m, b = (np.stack([s.to_numpy(np.float64) for s in cols[i : i + len(LABELS)]], 1) for i in range(0, len(cols), len(LABELS)))
        x = e + log_sum((b - m)[:, None, :] + np.array(FILE_IN_DIR)[None])
        return pd.DataFrame({"label": np.array(LABELS, object)[x.argmax(1)], "confidence": np.exp(x.max(1) - log_sum(x))})

    x = ev.join(all_dirs, ["repo", "dir"])
    x = x.withColumn("x", F.pandas_udf(decide, "label string, confidence double")(*(F.col(f"{c}{i}") for c in "emb" for i in k)))
    return x.select(F.col("id").alias(id_col), *kept, "x.label", "x.confidence")
