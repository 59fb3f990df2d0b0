import json
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataline import common
from strataline.common import stage
from strataline.operators import drift
from strataline.operators.drift import _kinds, assign, changes, column_names, name_similarity, profile, sketch, to_text, unify, walk


def lines(spark, files, feed="f"):
    rows = [(feed, no, i, p if isinstance(p, str) or p is None else json.dumps(p)) for no, records in files.items() for i, p in enumerate(records, 1)]
    return spark.createDataFrame(rows, "feed string, file_no int, line_no int, payload string")


def found(spark, files):
    raw = lines(spark, files)
    return sorted(tuple(r)[1:5] for r in changes(raw, profile(raw)).collect())


def unified(spark, files):
    raw = lines(spark, files)
    kinds = stage(profile(raw))
    return unify(raw, kinds, stage(changes(raw, kinds)))


ENV = [{"tags": {"env": e}, "n": i} for i, e in enumerate(["prod", "dev", "qa", "prod", "dev"] * 4)]


def test_moves_and_renames(spark):
    moved = [{"env": r["tags"]["env"], "tags": {"env2": None}, "n": r["n"]} for r in ENV]
    got = found(spark, {1: ENV, 2: moved})
    assert (2, "renamed", "tags.env", "env") in got and (2, "added", "tags.env2", "") in got and len(got) == 2


def test_objects_are_renamed_whole(spark):
    a = [{"cluster": {"workers": i, "version": f"rt-{i % 3}"}} for i in range(20)]
    b = [{"compute": r["cluster"]} for r in a]
    assert found(spark, {1: a, 2: b}) == [(2, "renamed", "cluster", "compute")]


def test_kinds(spark):
    files = {1: [{"x": 1}], 2: [{"x": None}], 3: [{"x": "1"}], 4: [{"x": "1"}, {"x": 2}], 5: [{"x": {"y": 1}}], 6: [{}]}
    assert found(spark, files) == [(3, "type_changed", "x", ""), (4, "type_changed", "x", ""), (5, "type_changed", "x", ""), (6, "removed", "x", "")]


def test_unlike_fields_are_no_rename(spark):
    a = [{"env": "prod"}, {"env": "dev"}] * 5
    b = [{"tier": "gold"}, {"tier": "silver"}] * 5
    assert found(spark, {1: a, 2: b}) == [(2, "added", "tier", ""), (2, "removed", "env", "")]


def test_gaps_bad_lines_and_empty(spark):
    assert found(spark, {1: [{"x": 1}], 3: [{"y": 1}]}) == []
    assert found(spark, {1: [{"x": 1}, "{", "[1]", None], 2: [{"x": 2}]}) == []
    assert found(spark, {}) == []


def test_one_table_for_all_files(spark):
    b = [{"env": r["tags"]["env"], "n": str(r["n"])} for r in ENV]
    out = unified(spark, {1: ENV, 2: b})
    assert out.columns == ["feed", "file_no", "line_no", "n", "tags__env"]
    assert out.filter("tags__env is not null").count() == 40 and dict(out.dtypes)["n"] == "string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    score = np.random.default_rng(seed).random((n, m))
    got = sum(score[i, j] for i, j in assign(score))
    s = score if n <= m else score.T
    best = max(sum(s[i, p[i]] for i in range(s.shape[0])) for p in permutations(range(s.shape[1]), s.shape[0]))
    assert abs(got - best) < 1e-9 and Counter(i for i, _ in assign(score)).most_common(1)[0][1] == 1


def test_names():
    assert name_similarity("a.bytes_written", "b.bytesWritten") == 1 and name_similarity("env", "tier") < 0.3


def test_renamed_texts_of_a_hot_file_are_compared_whole(spark):
    """Most of the hot file's values are four frequent words; they stand among thousands of rare ones."""
    hot = [{"stage": f"rare{i}" if i % 3 == 0 else ["prod", "dev", "qa", "live"][i % 4]} for i in range(18000)]
    few = [{"label": w} for w in ("prod", "dev", "qa", "live")] * 3
    assert found(spark, {1: hot, 2: few}) == [(2, "renamed", "stage", "label")]


def test_sketches_do_not_depend_on_splits(spark):
    rows = lines(spark, {1: [{"note": f"w{i % 700} v{i % 11}"} for i in range(2000)]})
    wanted = spark.createDataFrame([("f", 1, "note")], "feed string, file_no int, path string")
    one, many = ({tuple(r) for r in sketch(rows.repartition(k, "line_no"), wanted).collect()} for k in (1, 5))
    assert one == many and sum(r[4] for r in one if r[3].startswith("t:")) == 4000


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr("strataline.operators.drift.HELD_COUNTS", 10)
    rows = pd.DataFrame([("f", 1, json.dumps({f"note{i % 30}": "x"})) for i in range(300)], columns=["feed", "file_no", "payload"])
    parts = list(_kinds(iter([rows])))
    assert len(parts) > 5 and pd.concat(parts).query("path == 'note7' and feature == 'k:string'").n.sum() == 10


def test_no_value_is_lost_in_the_one_table(spark):
    big = 9007199254740993
    files = {1: [{"id": big, "zip": "007", "x": 1, "y": 1.50, "z": True, "w": 10**30}, {"id": 1, "zip": "12", "x": 2.5, "y": 2.0, "z": None, "w": 2}]}
    out = unified(spark, files)
    assert dict(out.dtypes) == {"feed": "string", "file_no": "int", "line_no": "int", "id": "bigint", "w": "string", "x": "double", "y": "double", "z": "boolean", "zip": "string"}
    assert tuple(out.orderBy("line_no").first())[3:] == (big, str(10**30), 1.0, 1.5, True, "007")
    mixed = unified(spark, {1: [{"a": big}, {"a": 0.50}, {"a": [1, {"b": None}]}, {"a": "t"}, {"a": False}]})
    assert [r.a for r in mixed.orderBy("line_no").collect()] == [str(big), "0.5", '[1, {"b": null}]', "t", "false"]


def test_a_name_used_again_is_another_field(spark):
    a = [{"team": t} for t in ("red", "blue", "green")] * 4
    b = [{"squad": r["team"]} for r in a]
    c = [{"squad": r["team"], "team": i} for i, r in enumerate(a)]
    out = unified(spark, {1: a, 2: b, 3: c, 4: c})
    assert out.columns[3:] == ["team", "team@3"] and dict(out.dtypes)["team@3"] == "bigint"
    assert out.filter("team in ('red', 'blue', 'green')").count() == 48 and out.filter("`team@3` is not null").count() == 24


def test_clashing_names(spark):
    assert column_names(["a.b", "a__b", "A__b", "feed"], ["feed"]) == {"A__b": "A__b", "a.b": "a__b__2", "a__b": "a__b__3", "feed": "feed__2"}
    out = unified(spark, {1: [{"a__b": 1, "a": {"b": 2}, "feed": "x"}]})
    assert sorted(out.first().asDict().values(), key=str) == [1, 1, 1, 2, "f", "x"]


def test_very_deep_objects(spark):
    deep = '{"k":' * 1500 + "1" + "}" * 1500
    assert sum(1 for _ in walk(json.loads(deep))) == 1500
    assert found(spark, {1: [{"x": 1}], 2: ['{"x": 1, "d": %s}' % deep]}) == [(2, "added", "d", "")]
    assert to_text([{"a": [1, "é"]}]) == '[{"a": [1, "é"]}]'


def test_nothing_that_grows_with_the_files_is_broadcast(spark, monkeypatch):
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(drift, "stage", written)
    # A lookup so small that it is broadcast on purpose would hide what the planner chooses.
    monkeypatch.setattr(common, "is_small", lambda table: False)
    raw = lines(spark, {1: ENV, 2: [{"mode": r["tags"]["env"], "n": str(r["n"])} for r in ENV]})
    out = changes(raw, stage(profile(raw)))
    assert {(r["change_kind"], r["field_path"]) for r in out.collect()} >= {("type_changed", "n")}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_lookups_of_many_rows_in_small_files_are_spread(spark):
    lookup = stage(spark.range(0, 200_000, 1, 2).selectExpr("id", "repeat('a long text that repeats ', 8) as text"))
    assert lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= common.BROADCAST_BYTES and not common.is_small(lookup)
    out = common.salted_lookup(spark.range(100).withColumn("salt", F.col("id")), lookup, ["id"], ["salt"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("text is not null").count() == 100
