import math

import pytest
from pyspark.sql import functions as F

from ferrule.config import Settings, allowed_origins
from ferrule.functions import names, vectors


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in cols.items()) or "x int"
    return spark.createDataFrame([tuple(v for v, _ in cols.values()) or (1,)], schema).select(expr.alias("o")).first()["o"]


def test_chunk_id(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, names.chunk_id(lit("r"), lit("src/a\\b.py"), lit(None), lit("f"), lit("(x, y)"))) == "r::src.a.b.py::module.f::814095bb"
    assert one(spark, names.chunk_id(lit("r"), lit("m.py"), lit(""), lit("A"), lit(""))) == "r::m.py::module.A::e3b0c442"
    assert one(spark, names.chunk_id(lit("r"), lit("m.py"), lit("K"), lit("A"), lit(None))) == "r::m.py::K.A::e3b0c442"


@pytest.mark.parametrize(("raw", "base"), [("fetch_user", "fetch_user"), ("self.validate", "validate"), ("self.a.b", "a.b"), ("this.handleClick", "handleClick"), ("os.path.join", "os"), ("obj.method", "obj"), ("selfish.x", "selfish"), ("", "")])
def test_base_name(spark, raw, base):
    assert one(spark, names.base_name("s"), s=(raw, "string")) == base


def test_snippet_and_tokens(spark):
    assert one(spark, names.snippet("s"), s=("x" * 201, "string")) == "x" * 200 + "..."
    assert one(spark, names.snippet("s"), s=("x" * 200, "string")) == "x" * 200
    assert one(spark, names.snippet("s"), s=(None, "string")) is None
    assert one(spark, names.tokens("s"), s=("A b_2, c!", "string")) == ["a", "b_2", "c"]
    assert one(spark, names.search_content("s", F.lit(None).cast("string"), F.lit("t")), s=("f", "string")) == "Symbol: f\nDocs: \nt"
    assert one(spark, names.newlines("s"), s=("a\nb\n", "string")) == 2


def test_vectors(spark):
    v = lambda a: (a, "array<double>")
    assert one(spark, vectors.euclidean("a", "b"), a=v([1.0, 0.0]), b=v([0.5, 0.5])) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vectors.cosine("a", "b"), a=v([1.0, 0.0]), b=v([2.0, 0.0])) == pytest.approx(1)
    assert one(spark, vectors.cosine("a", "b"), a=v([0.0, 0.0]), b=v([2.0, 0.0])) is None
    assert one(spark, vectors.truncated("a", 2), a=v([3.0, 4.0, 9.0])) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.truncated("a", 2), a=v([0.0, 0.0, 9.0])) == [0, 0]
    assert one(spark, vectors.truncated("a", 2), a=v(None)) is None
    assert one(spark, vectors.dot("a", "b"), a=v([1.0]), b=v([1.0, 2.0])) is None
    with pytest.raises(ValueError, match="unknown metric"):
        vectors.similarity("a", "b", "hamming")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nFERRULE_TOP_K=7\nFERRULE_JUDGE_RATE=0.5\n")
    s = Settings.from_env({"FERRULE_TOP_K": "9"}, str(tmp_path / ".env"))
    assert (s.top_k, s.judge_rate) == (9, 0.5)
    for bad in ({"top_k": 0}, {"judge_rate": 2.0}, {"window_stride": 5000}, {"bm25_scope": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert allowed_origins(" a, ,b ") == ["a", "b"]
