import random

from strataline.cdc import EVENT_COLUMNS
from strataline.operators.change_feed import apply_changes
from strataline.streaming.change_stream import current_rows, follow_changes, merge_batch, windowed_counts
from tests.test_change_feed import event


def test_change_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    schema = spark.createDataFrame([], EVENT_COLUMNS).schema
    for i, events in enumerate([[event(1, "1", "insert", after=1), event(2, "2", "insert", after=2)], [event(3, "3", "delete", before=1), event(4, "1", "insert", after=1)]]):
        spark.createDataFrame(events, EVENT_COLUMNS).coalesce(1).write.mode("append").json(str(inbox))
        q = follow_changes(spark.readStream.schema(schema).json(str(inbox)), str(tmp_path / "state"), str(tmp_path / "check"))
        q.awaitTermination()
        assert q.exception() is None
        rows = [(r.row_id, r.checkpoint_token) for r in current_rows(spark, str(tmp_path / "state"), i).orderBy("row_id").collect()]
        assert rows == ([(1, "1"), (2, "2")] if i == 0 else [(2, "2")])


def test_batches_in_any_order_give_what_one_pass_gives(spark):
    rng, events = random.Random(3), []
    for n in range(1, 120):
        a, b = rng.randrange(8), rng.randrange(8)
        op = rng.choice(["insert", "update", "update", "delete"] + ["truncate"] * (n % 41 == 0))
        events.append(event(n, str(n), op, None if op in ("insert", "truncate") else a, None if op in ("delete", "truncate") else b if rng.random() < 0.3 else a))
    rng.shuffle(events)
    state = None
    for at in range(0, len(events), 40):
        state = merge_batch(spark.createDataFrame(events[at : at + 40], EVENT_COLUMNS), state)
    got = sorted((r.row_id, r.checkpoint_token) for r in state[0].filter("writes").collect())
    assert got == sorted((r.row_id, r.checkpoint_token) for r in apply_changes(spark.createDataFrame(events, EVENT_COLUMNS)).collect())


def test_windows(spark):
    df = spark.sql("select timestamp'2021-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2021-01-01 00:50:00', 'a' union all select timestamp'2021-01-01 01:00:00', 'a'")
    assert [r.n for r in windowed_counts(df, "ts", ["k"]).orderBy("window_start").collect()] == [2, 1]
