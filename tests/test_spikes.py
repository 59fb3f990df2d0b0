import math
import random

import numpy as np
import pytest

from strataline.operators import spikes
from strataline.operators.spikes import implausible, pursuit, stuck

DAY = 86_400_000
SCHEMA = "source bigint, id bigint, at bigint, value double, ok boolean, most double"


def series(source, n, value, per_day=6, ok=lambda i: True):
    return [(source, source * 100_000 + i, i * DAY // per_day, value(i), ok(i), 1e12) for i in range(n)]


def found(spark, rows):
    return {(r.id, r.kind) for r in implausible(spark.createDataFrame(rows, SCHEMA)).collect()}


def noisy(seed, spread=0.1):
    rng = random.Random(seed)
    values = {}
    return lambda i: values.setdefault(i, 1000 * math.exp(rng.gauss(0, spread)))


def test_spikes_and_recurring_runs(spark):
    base = noisy(1)
    value = lambda i: 40_000.0 if i == 77 else 30.0 if i == 120 else base(i) * (4 if i % 8 == 0 else 1)
    assert found(spark, series(1, 180, value)) == {(100_077, "spike"), (100_120, "spike")}


def test_levels_and_growth_are_ordinary(spark):
    a, b = noisy(2), noisy(3)
    rows = series(1, 180, lambda i: a(i) * (5 if i > 90 else 1)) + series(2, 180, lambda i: b(i) * (1 + i / 20))
    assert found(spark, rows) == set()


def test_small_sources_have_no_spikes(spark):
    assert found(spark, series(1, 39, lambda i: 1e5 if i == 20 else 100.0 + i)) == set()


def test_impossible_values(spark):
    rows = [(1, i, i, v, ok, 50.0) for i, (v, ok) in enumerate([(-1.0, True), (math.nan, True), (math.inf, False), (0.0, True), (0.0, False), (51.0, True), (None, True), (50.0, None), (0.0, None)])]
    assert found(spark, rows) == {(i, "impossible") for i in (0, 1, 2, 3, 5)}


@pytest.mark.parametrize("partitions", [2, 40])
def test_stuck_values_over_partition_borders(spark, partitions):
    base = noisy(4)
    # Failed runs between do not end a stretch; five equal readings are no case.
    rows = series(1, 120, lambda i: 777.0 if 30 <= i < 37 else 888.0 if 60 <= i < 65 else base(i), ok=lambda i: i not in (32, 33))
    rows += series(2, 60, lambda i: 5.0 if i < 60 else 1.0)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.id for r in stuck(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == {200_000 + i for i in range(60)}
    rows = series(1, 120, lambda i: 777.0 if 30 <= i < 38 else base(i), ok=lambda i: i not in (32, 33))
    assert {r.id for r in stuck(spark.createDataFrame(rows, SCHEMA)).collect()} == {100_000 + i for i in (30, 31, 34, 35, 36, 37)}


def test_empty_input(spark):
    assert found(spark, []) == set()


def test_pursuit_separates_sparse_from_low_rank():
    rng = np.random.default_rng(0)
    low = np.outer(rng.normal(size=60), rng.normal(size=60))
    sparse = np.zeros((60, 60))
    sparse[[3, 17, 30], [2, 5, 8]] = [6, -5, 7]
    got_low, got_sparse = pursuit(np.stack([low + sparse, low]))
    assert np.abs(got_sparse[0] - sparse).max() < 1e-3 and np.abs(got_low[1] - low).max() < 1e-3


def test_pursuit_of_narrow_daily_profiles_points_at_the_spikes():
    rng = np.random.default_rng(1)
    days = np.outer(rng.normal(0, 0.3, 40), np.ones(7)) + np.linspace(-1, 1, 7)
    days[11, 6] += 2.0
    sparse = pursuit(days[None])[1][0]
    assert np.unravel_index(np.abs(sparse).argmax(), sparse.shape) == (11, 6) and sparse[11, 6] > 0.5


def test_null_sources_are_tested_for_impossible_values_only(spark):
    rows = [(None, i, i, -1.0 if i == 3 else 7.0, True, None) for i in range(50)]
    assert found(spark, rows) == {(3, "impossible")}


def test_readings_without_a_time_are_no_spikes(spark):
    base = noisy(9)
    rows = series(1, 120, lambda i: 40_000.0 if i == 77 else base(i)) + [(1, 5, None, 50_000.0, True, None), (1, 6, None, -1.0, True, None)]
    assert found(spark, rows) == {(100_077, "spike"), (6, "impossible")}


def test_one_hot_source(spark):
    base = noisy(5)
    rows = series(1, 6000, lambda i: base(i) * (6 if i == 4321 else 1), per_day=200) + series(2, 60, noisy(6))
    assert found(spark, rows) == {(104_321, "spike")}


def lasting_level(source):
    base = noisy(7, 0.05)
    # The last three of 60 days run at six times the level: few readings, but a level and no spikes. One true spike besides.
    return series(source, 60 * 20, lambda i: 60_000.0 if i == 300 else base(i) * (6 if i >= 57 * 20 else 1), per_day=20)


def test_the_pursuit_keeps_a_short_level_that_the_gap_rule_would_take(spark):
    rows = lasting_level(1)
    assert found(spark, rows) == {(100_300, "spike")}
    # By the gap alone all readings of the new level would be spikes.
    values = np.array(sorted(r[3] for r in rows))
    assert (values >= spikes._cut(values, values, np.ones(len(values)), len(values))).sum() == 61


def test_without_a_sparse_part_there_are_no_spikes():
    days = [{"period": d, "least": 900.0, "middle": [950.0, 975.0, 1000.0, 1025.0, 1050.0], "most": 9e4 if d == 7 else 1100.0, "n": 20} for d in range(30)]
    import pandas as pd

    batch = pd.DataFrame({"source": [1], "rows": [days]})
    (named,) = spikes._named(iter([batch]))
    assert named["period"].tolist() == [7] and 1400 < named["high_from"][0] < 1700
    was = spikes.pursuit
    try:
        spikes.pursuit = lambda x, days=None: (x, np.zeros_like(x))
        assert next(spikes._named(iter([batch]))).empty
    finally:
        spikes.pursuit = was


def test_many_readings_a_day_with_spikes_on_every_day_and_sources_of_text(spark):
    base = noisy(8)
    rows = [(f"s{s}", i, at, v, ok, m) for s, i, at, v, ok, m in series(1, 3000, lambda i: base(i) * (9 if i % 150 == 70 else 1), per_day=300)]
    df = spark.createDataFrame(rows, SCHEMA.replace("source bigint", "source string"))
    assert {(r.source, r.id) for r in implausible(df).collect()} == {("s1", 100_000 + i) for i in range(70, 3000, 150)}


def test_splits_do_not_depend_on_the_stack():
    rng = np.random.default_rng(4)
    x = rng.normal(10, 0.1, (1, 20, 7))
    x[0, 5, 6] += 3
    padded = np.zeros((3, 50, 7))
    padded[1, :20], padded[2] = x[0], rng.normal(10, 1, (50, 7))
    assert np.allclose(pursuit(x)[1][0], pursuit(padded, np.array([50, 20, 50]))[1][1, :20], atol=1e-6)
