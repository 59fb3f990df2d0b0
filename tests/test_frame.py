import pytest

from strataline.errors import EngineError, SchemaMismatch
from strataline.operators.dataset import Dataset
from strataline.operators.frame import Frame


@pytest.fixture(scope="module")
def people(spark):
    return Dataset.from_rows(spark, [("id", "int64"), ("active", "bool"), ("score", "float64"), ("grp", "utf8")], [[1, True, 10.0, "A"], [2, False, None, "A"], [3, True, 5.5, None], [4, True, None, "B"]])


def rows(frame):
    return sorted(map(tuple, frame.df.collect()), key=str)


def test_predicates(people):
    f = people.frame()
    assert [r[0] for r in rows(f.filter_eq("score", None))] == [2, 4]
    assert [r[0] for r in rows(f.filter_not_null("score"))] == [1, 3]
    assert [r[0] for r in rows(f.filter_mod_eq_int64("id", 2, 0))] == [2, 4]
    assert rows(f.filter_mod_eq_int64("id", 0, 0)) == []


def test_strict_names(people):
    f = people.frame()
    for call in (lambda: f.select(["no"]), lambda: f.rename([("no", "x")]), lambda: f.drop(["no"]), lambda: f.select(["ID"])):
        with pytest.raises(SchemaMismatch):
            call()
    with pytest.raises(SchemaMismatch):
        f.rename([("id", "score")])


def test_columns_with_dots_and_quotes(spark):
    d = Dataset.from_rows(spark, [("user.name", "utf8"), ("a`b", "int64")], [["x", 1]])
    f = d.frame().rename([("user.name", "n.m")]).fill_null("a`b", 2).select(["a`b", "n.m"])
    assert f.columns == ["a`b", "n.m"] and rows(f) == [(1, "x")]


def test_casts_and_derivations(people):
    f = people.frame()
    assert f.cast("id", "utf8").collect().to_rows()[0][0] == "1"
    assert f.cast("grp", "int64", "lossy").reduce("grp", "count_distinct") == 0
    with pytest.raises(EngineError):
        f.cast("grp", "int64").reduce("grp", "sum")
    with pytest.raises(EngineError):
        f.multiply_f64("grp", 2.0)
    with pytest.raises(EngineError):
        f.with_literal("x", None)
    assert f.with_mul_f64("x", "score", 2.0).reduce("x", "sum") == 31.0


def test_group_rules(people):
    f = people.frame()
    out = f.group_by(["grp"], [{"type": "sum", "column": "score", "alias": "s"}, {"type": "mean", "column": "score", "alias": "m"}, {"type": "count_rows", "alias": "n"}])
    assert rows(out) == sorted([("A", 10.0, 10.0, 2), (None, 5.5, 5.5, 1), ("B", 0.0, None, 1)], key=str)
    with pytest.raises(SchemaMismatch):
        f.group_by([], [{"type": "count_rows", "alias": "n"}])
    with pytest.raises(ValueError):
        f.group_by(["grp"], [{"type": "mode", "column": "id", "alias": "x"}])


@pytest.mark.parametrize(("how", "want"), [("inner", [(2, "b", "y")]), ("left", [(1, "a", None), (2, "b", "y"), (None, "n", None)]), ("right", [(2, "b", "y"), (3, None, "z"), (None, None, "q")]), ("full", [(1, "a", None), (2, "b", "y"), (3, None, "z"), (None, "n", None), (None, None, "q")])])
def test_joins(spark, how, want):
    left = Dataset.from_rows(spark, [("id", "int64"), ("v", "utf8")], [[1, "a"], [2, "b"], [None, "n"]]).frame()
    right = Dataset.from_rows(spark, [("key", "int64"), ("v", "utf8")], [[2, "y"], [3, "z"], [None, "q"]]).frame()
    out = left.join(right, ["id"], ["key"], how)
    assert out.columns == ["id", "v", "v_right"]
    assert rows(out) == sorted(want, key=str)
    with pytest.raises(SchemaMismatch):
        left.join(right, ["id"], [], how)


def test_self_join(people):
    f = people.frame()
    assert f.join(f, ["id"], ["id"]).df.count() == 4


def test_strict_collect_refuses_other_types(spark):
    with pytest.raises(SchemaMismatch):
        Frame(spark.sql("select current_timestamp() as t")).collect()


def test_feature_stats(spark):
    d = Dataset.from_rows(spark, [("a", "float64"), ("b", "float64"), ("t", "utf8")], [[10.0, 1.0, "x"], [20.0, None, "y"], [None, 3.0, "z"]])
    got = d.feature_wise_mean_std(["a", "b"])
    assert got["a"]["mean"] == 15 and got["b"]["std"] == pytest.approx(2**0.5)
    with pytest.raises(EngineError):
        d.feature_wise_mean_std(["t"])
