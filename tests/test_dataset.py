import math

import pytest

from strataline.errors import SchemaMismatch
from strataline.operators.dataset import ROW, Dataset, with_ordinal


@pytest.fixture(scope="module")
def x(spark):
    return Dataset.from_rows(spark, [("x", "float64"), ("t", "utf8")], [[1.0, "a"], [3.0, "b"], [3.0, "a"], [None, None]])


def test_reductions(x):
    assert [x.reduce("x", op) for op in ("count", "sum", "min", "max", "count_distinct")] == [4, 7.0, 1.0, 3.0, 2]
    assert x.reduce("x", "var_pop") == pytest.approx(8 / 9) and x.reduce("x", "l2") == pytest.approx(19**0.5)
    assert x.reduce("t", "sum") is None and x.reduce("nope", "sum") is None
    with pytest.raises(ValueError):
        x.reduce("x", "mode")


def test_empty_and_single(spark):
    one = Dataset.from_rows(spark, [("x", "int64")], [[42]])
    assert one.reduce("x", "var_sample") is None and one.reduce("x", "std_pop") == 0
    none = Dataset.from_rows(spark, [("x", "int64")], [])
    assert none.reduce("x", "sum") is None and none.frame().reduce("x", "sum") == 0
    assert none.arg_max_row("x") is None and none.top_k_by_frequency("x", 3) == []


def test_nan_is_ignored_by_extremes(spark):
    d = Dataset.from_rows(spark, [("x", "float64")], [[math.nan], [2.0], [1.0]])
    assert (d.reduce("x", "min"), d.reduce("x", "max")) == (1.0, 2.0)
    assert math.isnan(Dataset.from_rows(spark, [("x", "float64")], [[math.nan]]).reduce("x", "max"))


def test_arg_rows_take_the_first_of_ties(x):
    assert x.arg_max_row("x") == (1, 3.0) and x.arg_min_row("x") == (0, 1.0) and x.arg_max_row("no") is None


def test_top_k(spark, x):
    assert x.top_k_by_frequency("t", 2) == [("a", 2), ("b", 1)] and x.top_k_by_frequency("t", 0) == []
    d = Dataset.from_rows(spark, [("n", "int64")], [[-2], [-1], [5], [0]])
    assert [v for v, _ in d.top_k_by_frequency("n", 4)] == [0, 5, -1, -2]


def test_row_functions(x):
    assert x.filter(lambda r: r[1] == "a").to_rows() == [[1.0, "a"], [3.0, "a"]]
    assert x.map(lambda r: [r[0], (r[1] or "-") * 2]).to_rows()[3] == [None, "--"]
    with pytest.raises(Exception, match="2 cells"):
        x.map(lambda r: [1.0]).to_rows()
    assert x.fold(0.0, lambda a, r: a + (r[0] or 0)) == 7.0


def test_cells_are_checked(spark):
    for bad in ([["a"]], [[1.5]], [[True]], [[1, 2]]):
        with pytest.raises(SchemaMismatch):
            Dataset.from_rows(spark, [("x", "int64")], bad)


def test_ordinals(spark):
    df = spark.range(0, 1000, 1, 7)
    assert [r[ROW] for r in with_ordinal(df).orderBy("id").collect()] == list(range(1000))
    back = with_ordinal(df.selectExpr("-id as id"), ["id"]).orderBy("id").collect()
    assert [r[ROW] for r in back] == list(range(1000))
    assert with_ordinal(df.limit(0)).count() == 0


def test_arrow_round_trip(spark, x):
    assert Dataset.from_arrow(spark, x.to_arrow()).to_rows() == x.to_rows()


def test_records(spark):
    from dataclasses import dataclass

    @dataclass
    class Point:
        x: int
        t: str | None

    points = [Point(1, "a"), Point(2, None)]
    assert Dataset.from_records(spark, [("x", "int64"), ("t", "utf8")], points).to_records(Point) == points
