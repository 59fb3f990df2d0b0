import json

import pytest

from strataline import api, cdc
from strataline.errors import EngineError
from strataline.execution import Chunk, ExecutionEngine, ExecutionOptions, most_at_once
from strataline.operators.change_feed import apply_changes
from strataline.operators.dataset import Dataset
from strataline.plans.sql_context import SqlContext, query
from strataline.plans.transform import TransformSpec


@pytest.fixture(scope="module")
def data(spark):
    return Dataset.from_rows(spark, [("id", "int64"), ("score", "int64"), ("name", "utf8")], [[7, 30, "u"], [9, None, "v"]])


def test_sql(spark, data):
    assert query(data.frame(), "select name from df where score is not null").collect().to_rows() == [["u"]]
    c = SqlContext()
    with pytest.raises(EngineError):
        c.register(" ", data.frame())
    c.register("t", data.frame())
    out = c.execute("select count(*) as n from t a join t b on a.id = b.id")
    assert out.reduce("n", "sum") == 2 and not spark.catalog.tableExists("t")
    for bad in ("select nope from t", "select * from missing", "select from"):
        with pytest.raises(EngineError):
            c.execute(bad)


def test_transform_spec(data):
    spec = {
        "output_schema": {"fields": [{"name": "id", "data_type": "Int64"}, {"name": "s", "data_type": "Float64"}, {"name": "twice", "data_type": "Float64"}, {"name": "tag", "data_type": "Utf8"}]},
        "steps": [
            {"Rename": {"pairs": [["score", "s"]]}}, {"Cast": {"column": "s", "to": "Float64", "mode": "lossy"}}, {"FillNull": {"column": "s", "value": {"Float64": 0.0}}},
            {"DeriveMulF64": {"name": "twice", "source": "s", "factor": 2.0}}, {"WithLiteral": {"name": "tag", "value": {"Utf8": "x"}}}, {"Drop": {"columns": ["name"]}},
        ],
    }
    parsed = TransformSpec.from_json(json.dumps(spec))
    want = [[7, 30.0, 60.0, "x"], [9, 0.0, 0.0, "x"]]
    assert parsed.apply(data).to_rows() == want
    assert TransformSpec.from_json(parsed.to_json()).apply(data).to_rows() == want
    with pytest.raises(ValueError):
        TransformSpec.from_json({"output_schema": [], "steps": [{"Explode": {}}]})


def test_execution(data):
    events = []
    engine = ExecutionEngine(ExecutionOptions(chunk_size=1), events.append)
    assert engine.filter_parallel(data, lambda r: r[0] == 7).to_rows() == [[7, 30, "u"]]
    m = engine.metrics_snapshot()
    assert m.rows_processed == 2 and m.chunks_started == m.chunks_finished > 0
    assert engine.reduce(data, "score", "sum") == 30
    assert events[0].kind == "run_started" and events[-1].kind == "reduce_finished"
    for bad in ({"chunk_size": 0}, {"num_threads": 0}, {"max_in_flight_chunks": 0}):
        with pytest.raises(ValueError):
            ExecutionOptions(**bad)


@pytest.mark.parametrize("size,chunks", [(10, 8), (7, 12), (1000, 4)])
def test_chunk_size_decides_the_chunks(spark, size, chunks):
    rows = Dataset(spark.range(0, 80, 1, 4))
    engine = ExecutionEngine(ExecutionOptions(chunk_size=size))
    assert sorted(engine.map_parallel(rows, lambda r: [-r[0]]).to_rows()) == sorted([-i] for i in range(80))
    m = engine.metrics_snapshot()
    assert (m.chunks_started, m.chunks_finished, m.rows_processed, m.throttle_wait_s) == (chunks, chunks, 80, 0.0)


def test_bounds_hold_and_events_come_while_the_job_runs(spark):
    import time

    def slow(row):
        time.sleep(0.02)
        return row

    rows, times, events = Dataset(spark.range(0, 40, 1, 8)), [], []
    engine = ExecutionEngine(ExecutionOptions(chunk_size=5, max_in_flight_chunks=2), lambda e: (events.append(e), times.append(time.time())))
    engine.map_parallel(rows, slow)
    m = engine.metrics_snapshot()
    assert m.chunks_finished == 8 and m.max_active_chunks <= 2 and m.throttle_wait_s > 0
    assert [e.kind for e in events if e.kind == "throttle_waited"] == ["throttle_waited"] * 2
    free = ExecutionEngine(ExecutionOptions(chunk_size=5))
    free.map_parallel(rows, slow)
    assert free.metrics_snapshot().max_active_chunks > 2
    assert events[-1].kind == "run_finished" and [e.kind for e in events].count("chunk_started") == 8


def test_chunks_that_ran_at_once():
    assert most_at_once([Chunk(0, 0, 1, 0.0, 1.0), Chunk(1, 0, 1, 0.5, 2.0), Chunk(2, 0, 1, 1.0, 3.0)]) == 2 and most_at_once([]) == 0


def test_change_events(spark):
    class Feed:
        def __init__(self):
            self.left = [[("1", 1, "insert"), ("2", 2, "insert")], [("3", 1, "delete")]]

        def next_batch(self):
            if not self.left:
                return None
            meta = lambda n: cdc.SourceMeta("s", cdc.CdcCheckpoint(n))
            image = lambda i: cdc.RowImage.new([("id", i)])
            return [cdc.CdcEvent(meta(n), cdc.TableRef("t"), cdc.CdcOp(op), image(i) if op == "delete" else None, image(i) if op == "insert" else None) for n, i, op in self.left.pop(0)]

    events = [e for b in cdc.batches(Feed()) for e in b]
    rows = apply_changes(cdc.to_frame(spark, events)).collect()
    assert [(r["row_id"], r["image"]) for r in rows] == [(2, {"id": "2"})]


def test_flat_names(data):
    assert all(hasattr(api, n) for n in api.__all__)
    assert api.processing_reduce(data, "score", "max") == 30
    assert api.sql_query_dataset(data, "select max(id) as m from df").to_rows() == [[9]]
    assert api.extension_version()
