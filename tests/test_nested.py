from datetime import datetime

from strataline.operators.nested import NestedTables, TreeAutomaton, job_run_tables, short_names

SCHEMA = (
    "run_id bigint, job_id bigint, settings struct<name:string,tags:struct<team:string>>, metrics struct<duration_ms:double>, "
    "tasks array<struct<task_key:string,depends_on:array<string>,attempts:array<struct<attempt_no:int,duration_ms:double,errors:array<struct<code:string,message:string>>>>>>, received_at timestamp"
)


def runs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def task(key, *attempts):
    return (key, None, list(attempts))


EARLY, LATE = datetime(2021, 1, 1), datetime(2021, 1, 2)


def test_levels_and_parent_links(spark):
    df = runs(spark, [
        (1, 7, ("a", ("x",)), (1.0,), [task("t", (1, 2.0, [("E1", None), None, (None, None)])), None, task(None)], EARLY),
        (2, 7, None, None, None, EARLY), (3, None, ("b", None), None, [], EARLY),
    ])
    t = job_run_tables(df)
    assert t.table("run").count() == 3
    assert {(r.run_id, r.team) for r in t.table("run").collect()} == {(1, "x"), (2, None), (3, None)}
    assert {(r.task_pos, r.task_key) for r in t.table("task").collect()} == {(0, "t"), (2, None)}
    assert [(r.task_pos, r.task_key, r.attempt_pos, r.attempt_no, r.duration_ms) for r in t.table("attempt").collect()] == [(0, "t", 0, 1, 2.0)]
    errors = sorted((r.error_pos, r.code, r.shape) for r in t.table("error").collect())
    assert errors == [(0, "E1", "{s-}"), (2, None, "{--}")]


def test_fullest_then_latest_delivery_counts_once(spark):
    full, late = [task("t", (1, 1.0, [("E", "m")]))], [task("t", (1, 1.0, [("F", "m")]))]
    df = runs(spark, [(1, 1, None, None, full, EARLY), (1, 1, None, None, None, LATE), (1, 1, None, None, full, EARLY), (2, 1, None, None, full, EARLY), (2, 1, None, None, late, LATE)])
    got = sorted((r.run_id, r.code) for r in job_run_tables(df).table("error", columns=["code"]).collect())
    assert got == [(1, "E"), (2, "F")]


def test_variants_and_subtypes(spark):
    df = runs(spark, [(1, 1, ("n", ("t",)), None, None, EARLY), (2, None, None, (1.0,), None, EARLY), (3, 1, ("n", ("u",)), None, None, EARLY)])
    t = job_run_tables(df)
    counts = {r.shape: r.n for r in t.variants("run").collect()}
    assert sorted(counts.values()) == [1, 2]
    common = max(counts, key=counts.get)
    sub = t.subtype("run", common)
    assert sub.count() == 2 and "team" in sub.columns and "duration_ms" not in sub.columns and "run_id" in sub.columns


def test_empty_input_and_clashing_names(spark):
    assert all(x.count() == 0 for x in job_run_tables(runs(spark, [])).tables().values())
    df = spark.sql("select 1 as run_id, named_struct('id', 2) as a, named_struct('id', 3) as b, array(named_struct('run_id', 5, 'shape', 's')) as items")
    t = NestedTables(df, "run_id")
    assert {"a_id", "b_id"} <= set(t.table("record").columns)
    row = t.table("items").collect()[0].asDict()
    assert row["run_id"] == 1 and 5 in row.values() and "s" in row.values()
    assert short_names([("a", "x"), ("b", "x"), ("x",)]) == {"a_x": ("a", "x"), "b_x": ("b", "x"), "__x": ("x",)}


def test_states_of_arrays(spark):
    df = spark.sql("select array(1, null, 2) as a, array() as b, cast(null as array<int>) as c")
    auto = TreeAutomaton(df.schema)
    assert list(df.select(*[auto.state(df[c], df.schema[c].dataType) for c in "abc"]).first()) == ["[-|n]", "[]", "-"]


def test_errors_come_from_the_tables_of_their_variants(spark, monkeypatch):
    df = runs(spark, [(1, 7, None, None, [task("t", (1, 2.0, [("E1", None), None, (None, None), ("E2", "m"), (None, "m")]))], EARLY)])
    errors = job_run_tables(df).route("error")
    assert errors.shapes() == ["{--}", "{-s}", "{s-}", "{ss}"]
    tables = {shape: errors.table(shape) for shape in errors.shapes()}
    assert {s: t.columns[6:] for s, t in tables.items()} == {"{--}": [], "{-s}": ["message"], "{s-}": ["code"], "{ss}": ["code", "message"]}
    assert [t.count() for t in tables.values()] == [1, 1, 1, 1]
    assert sorted((r.error_pos, r.code) for r in errors.union().collect()) == [(0, "E1"), (2, None), (3, "E2"), (4, None)]
    # The state decides: if it calls everything null nothing is routed, if it calls nothing null the null element is.
    from pyspark.sql import functions as F

    for state, n in (("-", 0), ("{ss}", 5)):
        monkeypatch.setattr(TreeAutomaton, "state", lambda self, node, t=None, arrays=True, state=state: F.lit(state))
        assert job_run_tables(df).route("error", columns=["code"]).union().count() == n


def test_whole_variants_enter_arrays(spark):
    df = runs(spark, [(k, 7, None, None, [task("t", (1, 2.0, [("E1", None)] * k))], EARLY) for k in (1, 2)] + [(3, 7, None, None, [], EARLY)])
    assert sorted((r.shape, r.n) for r in job_run_tables(df).whole_variants().collect()) == [("{nn--[]o}", 1), ("{nn--[{s-[{nn[{s-}]}]}]o}", 2)]
