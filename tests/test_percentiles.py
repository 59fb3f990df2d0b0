import math
import random

import numpy as np
import pytest

from strataline.common import stage
from strataline.operators.percentiles import combine, percentiles, value_counts


def exact(values, p):
    return float(np.quantile(np.array(values), p))


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_against_numpy(spark, partitions):
    rng = random.Random(5)
    rows = [("hot", i % 7, rng.choice([rng.gauss(0, 10), 1.5])) for i in range(900)] + [("cold", 0, float(i)) for i in range(5)] + [(None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    fractions = [0, 0.1, 0.5, 0.77, 1]
    got = {(r.g, r.fraction): (r.value, r.n) for r in percentiles(value_counts(df, ["g"], "day", "v"), ["g"], fractions, partitions=partitions).collect()}
    for g in ("hot", "cold", None):
        values = [v for a, _, v in rows if a == g]
        for p in fractions:
            assert got[g, p][0] == pytest.approx(exact(values, p)) and got[g, p][1] == len(values)


def test_days_combine_exactly(spark):
    df = spark.range(1000).selectExpr("'a' as g", "id % 10 as day", "cast((id * 37) % 101 as double) as v")
    parts = [value_counts(df.filter(f"day = {d}"), ["g"], "day", "v") for d in range(10)]
    whole = percentiles(value_counts(df, ["g"], "day", "v"), ["g"], [0.5, 0.9]).orderBy("fraction").collect()
    assert percentiles(combine(*parts), ["g"], [0.5, 0.9]).orderBy("fraction").collect() == whole


def test_non_numbers_empty_groups_and_extra_columns(spark):
    rows = [("a", 1, math.nan, 0), ("a", 1, math.inf, 0), ("a", 1, None, 0), ("b", 1, -0.0, 0), ("b", 1, 0.0, 0)]
    df = spark.createDataFrame(rows, "g string, day int, v double, n int")
    out = percentiles(value_counts(df, ["g"], "day", "v"), ["g"], [0.5]).collect()
    assert [(r.g, r.value, r.n) for r in out] == [("b", 0.0, 2)]
    assert percentiles(value_counts(df.limit(0), ["g"], "day", "v"), ["g"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        percentiles(value_counts(df, ["g"], "day", "v"), ["g"], [1.5])


def test_integers_beyond_doubles_are_exact(spark):
    df = spark.range(0, 101).selectExpr("'g' as g", "'d' as d", "9007199254740992 + id as v")
    (r,) = percentiles(value_counts(df, ["g"], "d", "v"), ["g"], [0.5]).collect()
    assert (r["lower"], r["upper"], r["n"]) == (2**53 + 50, 2**53 + 50, 101)
    got = percentiles(value_counts(df, ["g"], "d", "v"), ["g"], [0.0, 0.25, 1.0], method="nearest").orderBy("fraction").collect()
    assert [x["value"] for x in got] == [2**53, 2**53 + 25, 2**53 + 100]


def test_a_group_of_a_third_of_all_values_from_stored_days(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', concat('t', id % 50)) as g", "id % 7 as d", "cast((id * 7919) % 30011 as double) as v")
    days = [stage(value_counts(df.filter(f"d = {d}"), ["g"], "d", "v")) for d in range(7)]
    got = {r["g"]: r["value"] for r in percentiles(combine(*days), ["g"], [0.5]).collect()}
    assert got == {g: float(p["v"].median()) for g, p in df.toPandas().groupby("g")}


def test_nothing_of_the_size_of_the_groups_is_broadcast(spark):
    df = spark.range(2000).selectExpr("id % 500 as g", "0 as d", "cast(id as double) as v")
    out = percentiles(stage(value_counts(df, ["g"], "d", "v")), ["g"], [0.25, 0.5])
    assert out.count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
