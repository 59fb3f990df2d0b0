"""Running row functions in bounded chunks, with events and metrics."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count
from typing import Any

from pyspark.accumulators import AccumulatorParam

from strataline.common import stage
from strataline.operators.dataset import Dataset


@dataclass(frozen=True)
class ExecutionOptions:
    """``chunk_size``: rows that a function's chunk holds at most. ``num_threads`` and ``max_in_flight_chunks``: chunks that run at
    once at most, the smaller counts; where both are left out the cluster's cores decide."""

    num_threads: int | None = None
    chunk_size: int = 4096
    max_in_flight_chunks: int | None = None

    @property
    def bound(self) -> int | None:
        return min((n for n in (self.num_threads, self.max_in_flight_chunks) if n is not None), default=None)

    def __post_init__(self):
        if self.num_threads is not None and self.num_threads < 1 or self.chunk_size < 1 or self.max_in_flight_chunks is not None and self.max_in_flight_chunks < 1:
            raise ValueError("num_threads, chunk_size and max_in_flight_chunks must be at least 1")


@dataclass(frozen=True)
class ExecutionEvent:
    """kind: run_started, throttle_waited, chunk_started, chunk_finished, reduce_started, reduce_finished, run_finished."""

    kind: str
    run_id: int
    detail: dict[str, Any]


@dataclass(frozen=True)
class Metrics:
    run_id: int = 0
    elapsed_s: float = 0.0
    rows_processed: int = 0
    chunks_started: int = 0
    chunks_finished: int = 0
    throttle_wait_s: float = 0.0
    max_active_chunks: int = 0


def stderr_observer(event: ExecutionEvent) -> None:
    print(event, file=sys.stderr)


@dataclass(frozen=True)
class Chunk:
    """One chunk as it ran: its partition and number there, its rows, and when (seconds since 1970)."""

    partition: int
    number: int
    rows: int
    began: float
    ended: float


class _Chunks(AccumulatorParam):
    def zero(self, value: list) -> list:
        return []

    def addInPlace(self, a: list, b: list) -> list:  # noqa: N802
        a.extend(b)
        return a


def most_at_once(chunks: list[Chunk]) -> int:
    """The greatest number of chunks that ran at the same time."""
    now = most = 0
    for _, step in sorted([(c.began, 1) for c in chunks] + [(c.ended, -1) for c in chunks]):
        now += step
        most = max(most, now)
    return most


class ExecutionEngine:
    """Row functions over chunks of at most ``chunk_size`` rows, inside Spark's tasks. A bound on chunks that run at once is a bound on
    tasks: rows are gathered into as many partitions, without a shuffle, and chunks of one partition run one after another.

    Chunks report themselves from where they run; events are passed on while the job runs, whenever a task has ended, and a repeated
    task's chunks count once. The wait is the time from the run's beginning to a partition's first chunk, where there is a bound.
    Results are written to the shared folder, so they are computed once and hold no memory.
    """

    _runs = count(1)
    POLL_S = 0.05

    def __init__(self, options: ExecutionOptions | None = None, observer: Callable[[ExecutionEvent], None] | None = None):
        self.options, self.observer, self.metrics = options or ExecutionOptions(), observer, Metrics()

    def _tell(self, kind: str, run: int, **detail: Any) -> None:
        if self.observer:
            self.observer(ExecutionEvent(kind, run, detail))

    def _run(self, data: Dataset, work: Callable[..., Dataset]) -> Dataset:
        run, began, since = next(self._runs), time.monotonic(), time.time()
        self._tell("run_started", run)
        sc = data.df.sparkSession.sparkContext
        log, bound = sc.accumulator([], _Chunks()), self.options.bound
        source = Dataset(data.df.coalesce(bound), data._schema, data.order_by) if bound else data
        out = work(source, log, self.options.chunk_size)
        chunks: dict[tuple[int, int], Chunk] = {}
        waits: dict[int, float] = {}

        def pass_on() -> None:
            for c in sorted((c for c in log.value[len(passed) :]), key=lambda c: (c.began, c.partition, c.number)):
                passed.append(c)
                if (c.partition, c.number) in chunks:
                    continue
                chunks[c.partition, c.number] = c
                if bound and c.partition not in waits:
                    waits[c.partition] = max(0.0, c.began - since)
                    self._tell("throttle_waited", run, partition=c.partition, seconds=waits[c.partition])
                self._tell("chunk_started", run, partition=c.partition, chunk=c.number, at=c.began)
                self._tell("chunk_finished", run, partition=c.partition, chunk=c.number, rows=c.rows, at=c.ended)

        passed: list[Chunk] = []
        done = threading.Event()

        def watch() -> None:
            while not done.wait(self.POLL_S):
                pass_on()

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            out = Dataset(stage(out.df), out._schema, out.order_by)
        finally:
            done.set()
            watcher.join()
        pass_on()
        ran = list(chunks.values())
        self.metrics = Metrics(run, time.monotonic() - began, sum(c.rows for c in ran), len(ran), len(ran), sum(waits.values()), most_at_once(ran))
        self._tell("run_finished", run, metrics=self.metrics)
        return out

    def filter_parallel(self, data: Dataset, keep: Callable[[list[Any]], bool]) -> Dataset:
        """Rows for which ``keep`` is true, order kept."""
        return self._run(data, lambda d, *how: d.filter(keep, *how))

    def map_parallel(self, data: Dataset, fn: Callable[[list[Any]], list[Any]]) -> Dataset:
        return self._run(data, lambda d, *how: d.map(fn, *how))

    def reduce(self, data: Dataset, column: str, op: str) -> Any:
        run, began = next(self._runs), time.monotonic()
        self._tell("reduce_started", run, op=op)
        value = data.reduce(column, op)
        self.metrics = Metrics(run, time.monotonic() - began, data.row_count())
        self._tell("reduce_finished", run, op=op, value=value)
        return value

    def metrics_snapshot(self) -> Metrics:
        return self.metrics
