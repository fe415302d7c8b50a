"""Every core query with SQL against DuckDB on the smallest tables, and the shape of the repository."""

import ast
import glob
import os
from pathlib import Path

import duckdb
import pytest

from ferrule.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SQL = catalog.oracle_sql()


def norm(df):
    df = df[sorted(df.columns)]
    text = lambda x: "~" if x is None or x != x or str(x) == "<NA>" else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(x.item() if hasattr(x, "item") else x) for x in row) for row in df.astype(object).to_numpy().tolist())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    ours, theirs = catalog.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert norm(ours) == norm(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_subpackage():
    for p in [*ROOT.glob("ferrule/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in p.parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any("ferrule.llm" in x for x in names), p
