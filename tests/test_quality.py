import json

import pytest

from strataline import api
from strataline.errors import EngineError
from strataline.functions import quantile
from strataline.operators.dataset import Dataset
from strataline.quality.outliers import detect
from strataline.quality.profile import profile
from strataline.quality.validate import Severity, validate


@pytest.fixture(scope="module")
def data(spark):
    return Dataset.from_rows(spark, [("id", "int64"), ("score", "float64"), ("name", "utf8")], [[1, 10.0, "a"], [2, None, "b"], [2, 200.0, None]])


def test_profile(data):
    r = profile(data, {"quantiles": [0.0, 0.5, 1.0]})
    id_, score, name = r.columns
    assert (r.row_count, score.null_count, id_.distinct_count, name.numeric) == (3, 1, 2, None)
    assert score.numeric.quantiles == ((0.0, 10.0), (0.5, 200.0), (1.0, 200.0)) and score.numeric.mean == 105
    assert profile(data, {"head_rows": 2}).row_count == 2
    with pytest.raises(ValueError):
        profile(data, {"quantiles": [2.0]})
    assert json.loads(r.to_json())["columns"][2]["numeric"] is None
    assert "| name | utf8 | 1 | 2 | - | - | - | - | - | - |" in r.to_markdown() and "| id | int64 | 0 | 2 | 1 | 2 | " in r.to_markdown()


def test_profile_of_empty_tables(spark):
    assert profile(Dataset.from_rows(spark, [("a", "int64")], [])).row_count == 0


@pytest.mark.parametrize("ranked", [5, 100_000])
def test_order_statistics_are_exact(spark, monkeypatch, ranked):
    monkeypatch.setattr(quantile, "RANKED", ranked)
    df = spark.range(30_000).selectExpr("cast((id * 7919) % 10007 as double) as a", "case when id < 20000 then 5.0 when id < 25000 then -id else double('NaN') end as b", "cast(null as double) as c")
    got = {(r["column"], r["fraction"]): r["value"] for r in quantile.order_statistics(df, ["a", "b", "c"], [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    pdf = df.toPandas()
    for c in "ab":
        x = sorted(pdf[c].dropna())
        assert all(got[c, q] == x[int((len(x) - 1) * q + 0.5)] for q in (0.0, 0.1, 0.5, 0.95, 1.0))
    assert not any(c == "c" for c, _ in got)
    middle = quantile.order_statistics(df, ["a"], [0.5], method="linear").first()
    assert middle["value"] == pdf["a"].median() and middle["n"] == 30_000


@pytest.mark.parametrize("ranked", [5, 100_000])
def test_order_statistics_of_infinite_values_and_large_integers(spark, monkeypatch, ranked):
    monkeypatch.setattr(quantile, "RANKED", ranked)
    df = spark.range(100).selectExpr("case when id < 20 then double('-Infinity') when id >= 80 then double('Infinity') else double(id) end as v", "9007199254740992 + id as k")
    assert [r["value"] for r in quantile.order_statistics(df, ["v"], [0.0, 0.5, 1.0]).orderBy("fraction").collect()] == [-float("inf"), 50.0, float("inf")]
    assert [r["value"] for r in quantile.order_statistics(df, ["k"], [0.0, 0.5, 1.0]).orderBy("fraction").collect()] == [2**53, 2**53 + 50, 2**53 + 99]


def test_large_integers_are_told_apart(spark):
    (c,) = profile(Dataset(spark.range(2**53, 2**53 + 10))).columns
    assert (c.distinct_count, c.numeric.min, c.numeric.max) == (10, 2**53, 2**53 + 9)


def test_validation(data):
    checks = [
        {"kind": "not_null", "column": "name", "severity": "warn"}, {"kind": "range", "column": "score", "min": 0, "max": 100}, {"kind": "unique", "column": "id", "severity": "info"},
        {"kind": "regex", "column": "name", "pattern": "^[ab]$"}, {"kind": "in_set", "column": "score", "values": [10.0]}, {"kind": "in_set", "column": "id", "values": []},
        {"kind": "regex", "column": "name", "pattern": "(", "strict": False},
    ]
    r = validate(data, checks)
    assert [x.failed_count for x in r.results] == [1, 1, 1, 0, 1, 3, 2]
    assert r.results[1].examples == [200.0] and r.results[2].examples == [] and r.max_severity is Severity.ERROR
    assert "score: 1 values lie outside 0 to 100" in r.to_markdown()
    assert json.loads(r.to_json())["summary"]["failed_checks"] == 6
    assert validate(data, {"checks": checks[:1], "max_examples": 0}).results[0].examples == []
    with pytest.raises(EngineError):
        validate(data, [{"kind": "regex", "column": "name", "pattern": "("}])


def test_outliers(spark):
    d = Dataset.from_rows(spark, [("x", "float64"), ("t", "utf8")], [[1.0, ""], [2.0, ""], [3.0, ""], [1000.0, ""], [None, ""]])
    r = detect(d, "x", {"kind": "tukey"})
    assert (r.row_count, r.outlier_count, r.examples) == (5, 1, [1000.0])
    assert (r.stats["lower_fence"], r.stats["upper_fence"]) == (0.5, 4.5)
    assert detect(d, "x", "mad").outlier_count == 1 and detect(d, "x", "z_score").outlier_count == 0
    assert detect(Dataset.from_rows(spark, [("x", "int64")], [[5], [5]]), "x", "mad").outlier_count == 0
    assert api.detect_outliers(d, "x", "iqr")["outlier_count"] == 1 and "lower_fence" in api.detect_outliers_markdown(d, "x", "iqr")
    with pytest.raises(EngineError):
        detect(d, "t", "iqr")
