import datetime as dt
import random

from pyspark.sql import functions as F

from ferrule.operators import orphans

DAY = dt.datetime(2024, 1, 1)


def t(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def brute(refs, parents):
    out = set()
    for i, k, at in refs:
        if k is None or not k.strip():
            continue
        rows = [(s, u) for p, s, u in parents if p == k]
        if not rows:
            out.add((i, "missing"))
        elif at is not None:
            early = [(s, u) for s, u in rows if s is not None and s <= at]
            if not any(u is None or u > at for _, u in early):
                out.add((i, "deleted" if early else "late"))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    keys = [f"k{i}" for i in range(40)]
    parents = [(r.choice(keys), r.choice([None, *range(30)]), r.choice([None, None, *range(40)])) for _ in range(60)] + [("hot", 1, None)] * 2 + [(None, 1, 2)]
    refs = [(i, r.choice([*keys, "gone", None, "", " \t", "hot", "hot", "hot", "hot"]), r.choice([None, *range(40)])) for i in range(400)]
    p = spark.createDataFrame([(k, t(a), t(b), "x") for k, a, b in parents], "id string, since timestamp, until timestamp, key string")
    f = spark.createDataFrame([(i, k, t(a), 0) for i, k, a in refs + refs[:20]], "ref long, key string, at timestamp, kind int")
    got = orphans.orphan_references(f, p, "ref", "key", "at", "id", "since", "until", parts=5)
    want = brute([(i, k, a) for i, k, a in refs], parents)
    assert {(x["ref_id"], x["kind"]) for x in got.collect()} == want
    assert got.count() == len(want)
    report = orphans.orphan_report(got.withColumn("side", F.lit("s")), "refs")
    assert report.agg(F.sum("orphans")).first()[0] == len(want)


def test_empty_tables(spark):
    p = spark.createDataFrame([], "id string, since timestamp, until timestamp")
    f = spark.createDataFrame([(1, "a", t(1))], "ref long, key string, at timestamp")
    assert [r["kind"] for r in orphans.orphan_references(f, p, "ref", "key", "at", "id", "since", "until").collect()] == ["missing"]
    assert orphans.orphan_references(f.limit(0), p, "ref", "key", "at", "id", "since", "until").count() == 0
