"""Dataset: a typed table whose row order counts, with row functions and scalar reductions.

The order is an ordinal column, attached only when an operator needs it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.common import prefix_sums, running_total, stage
from strataline.errors import EngineError, SchemaMismatch, translated
from strataline.functions.aggregates import build, parse_reduce_op, variance_kind
from strataline.operators.frame import Frame
from strataline.types import DataType, Schema, canonical, col, logical, schema_of

ROW = "__row"


def with_ordinal(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """``df`` with a contiguous ordinal from 0.

    With ``order_by`` (a unique key) it follows that order, by a range partitioning; otherwise the order in which
    partitions and their rows come, from per-partition counts: a small table, no shuffle of rows.
    """
    if order_by:
        return prefix_sums(df.withColumn("__one", F.lit(1)), [], list(order_by), "__one", ROW).drop("__one", "pid")
    # Written once, so that both passes see the same rows in the same partitions.
    marked = stage(df.withColumn("__id", F.monotonically_increasing_id()))
    pid = F.shiftrightunsigned("__id", 33).alias("__pid")
    offsets = running_total(marked.groupBy(pid).agg(F.count(F.lit(1)).alias("n")), [], ["__pid"], "n", "__start").drop("n")
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row a partition of the input.
    return marked.withColumn("__pid", pid).join(F.broadcast(offsets), "__pid").withColumn(ROW, (F.col("__start") + local).cast("bigint")).drop("__id", "__pid", "__start")


def chunks_of(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in chunks of ``size`` rows but for the last; without a size the batches themselves."""
    if size is None:
        yield from batches
        return
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == size:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def _cell(value: Any, kind: DataType, name: str) -> Any:
    good = value is None or {
        DataType.INT64: isinstance(value, int) and not isinstance(value, bool),
        DataType.FLOAT64: isinstance(value, float),
        DataType.BOOL: isinstance(value, bool),
        DataType.UTF8: isinstance(value, str),
    }[kind]
    if not good:
        raise SchemaMismatch(f"column '{name}' holds {value!r}, which is no {kind.title}")
    return value


class Dataset:
    """A typed table. ``df`` has exactly the schema's columns; ``order_by`` names a unique key that defines the row
    order, otherwise rows come as Spark delivers them."""

    def __init__(self, df: DataFrame, schema: Schema | None = None, order_by: Sequence[str] | None = None):
        self.df = canonical(df)
        self._schema = schema
        self.order_by = order_by

    @property
    def schema(self) -> Schema:
        """The logical schema; columns of other types raise when it is asked for."""
        self._schema = self._schema or schema_of(self.df)
        return self._schema

    @classmethod
    def from_rows(cls, spark: SparkSession, schema, rows: Iterable[Sequence[Any]]) -> "Dataset":
        """Rows in memory; cells must be of their field's type."""
        schema = Schema.of(schema)
        checked = []
        for row in rows:
            row = list(row)
            if len(row) != len(schema.fields):
                raise SchemaMismatch(f"a row has {len(row)} cells for {len(schema.fields)} fields")
            checked.append(tuple(_cell(v, f.data_type, f.name) for v, f in zip(row, schema.fields, strict=True)))
        return cls(spark.createDataFrame(checked, schema.to_struct()), schema)

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: pa.Table) -> "Dataset":
        """From Arrow; integers and floats widen, small and large strings are taken."""
        return cls(spark.createDataFrame(table))

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    @classmethod
    def from_records(cls, spark: SparkSession, schema, records: Iterable[Any]) -> "Dataset":
        """From dataclass instances or other objects with the schema's names as attributes."""
        schema = Schema.of(schema)
        return cls.from_rows(spark, schema, ([getattr(r, n) for n in schema.names] for r in records))

    def to_records(self, make: Callable[..., Any]) -> list[Any]:
        """Rows as ``make(**cells)``, such as instances of a dataclass."""
        return [make(**dict(zip(self.schema.names, r, strict=True))) for r in self.to_rows()]

    def __repr__(self) -> str:
        return f"Dataset({', '.join(f'{f.name}: {f.data_type.title}' for f in self.schema.fields)})"

    def frame(self) -> Frame:
        return Frame(self.df)

    def row_count(self) -> int:
        return self.df.count()

    def column_names(self) -> list[str]:
        return self.schema.names

    def ordered(self) -> DataFrame:
        return with_ordinal(self.df, self.order_by)

    def to_rows(self) -> list[list[Any]]:
        """All rows in order; for results that fit the driver."""
        return [list(r)[: len(self.schema.fields)] for r in (self.df.orderBy(*self.order_by) if self.order_by else self.df).collect()]

    def head(self, n: int) -> DataFrame:
        """The first n rows in the order of the table."""
        if self.order_by:
            return self.df.orderBy(*self.order_by).limit(n)
        return self.ordered().orderBy(ROW).limit(n).drop(ROW)

    # Row functions

    def _mapped(self, rows: Callable[[list[list[Any]]], list[Sequence[Any]]], log: Accumulator | None = None, chunk_size: int | None = None) -> "Dataset":
        """``log``: accumulator that takes every chunk as it ran; ``chunk_size``: rows of a chunk, else Spark's batches are the chunks."""
        names, arrow = self.df.columns, pa.schema([(f.name, {DataType.INT64: pa.int64(), DataType.FLOAT64: pa.float64(), DataType.BOOL: pa.bool_(), DataType.UTF8: pa.string()}[f.data_type]) for f in self.schema.fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, batch in enumerate(chunks_of(batches, chunk_size)):
                began = time.time()
                cells = [list(x) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
                out = rows(cells)
                if log is not None:
                    from strataline.execution import Chunk

                    log.add([Chunk(TaskContext.get().partitionId(), number, len(cells), began, time.time())])
                yield pa.record_batch([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(names))], schema=arrow)

        return Dataset(self.df.mapInArrow(run, self.schema.to_struct()), self.schema, self.order_by)

    def filter(self, keep: Callable[[list[Any]], bool], log: Accumulator | None = None, chunk_size: int | None = None) -> "Dataset":
        """Rows (lists of cells) for which ``keep`` is true, order kept. Prefer Frame predicates, which Spark optimises."""
        return self._mapped(lambda rows: [r for r in rows if keep(r)], log, chunk_size)

    def map(self, fn: Callable[[list[Any]], list[Any]], log: Accumulator | None = None, chunk_size: int | None = None) -> "Dataset":
        """Rows changed one by one; the schema stays, another number of cells raises."""
        width = len(self.schema.fields)

        def each(rows: list[list[Any]]) -> list[Sequence[Any]]:
            out = [fn(r) for r in rows]
            if any(len(r) != width for r in out):
                raise ValueError(f"map must return {width} cells a row")
            return out

        return self._mapped(each, log, chunk_size)

    def fold(self, initial: Any, fn: Callable[[Any, list[Any]], Any]) -> Any:
        """A sequential fold in row order, streamed through the driver."""
        width = len(self.schema.fields)
        rows = self.df.orderBy(*self.order_by) if self.order_by else self.df
        for r in rows.toLocalIterator():
            initial = fn(initial, list(r)[:width])
        return initial

    # Reductions

    def reduce(self, column: str, op: str) -> Any:
        """A scalar under dataset rules; None for an unknown column, null for text columns and empty sums."""
        if column not in self.df.columns:
            return None
        with translated("reduce"):
            value = self.df.agg(build(parse_reduce_op(op), self.df, column, "dataset").alias("value")).collect()[0][0]
        return value

    def feature_wise_mean_std(self, columns: Sequence[str], std_kind: str | None = None) -> dict[str, dict[str, float | None]]:
        variance_kind(std_kind)
        for c in columns:
            kind = self.schema.type_of(c)
            if kind is None or not kind.numeric:
                raise EngineError(f"column '{c}' is missing or not numeric")
        return self.frame().feature_wise_mean_std(columns, std_kind)

    def _arg(self, column: str, greatest: bool) -> tuple[int, Any] | None:
        if column not in self.df.columns:
            return None
        known = self.ordered().filter(col(column).isNotNull())
        back = F.struct(F.col(ROW), col(column).alias("x"))
        pick = F.max_by(back, F.struct(col(column), -F.col(ROW))) if greatest else F.min_by(back, F.struct(col(column), F.col(ROW)))
        found = known.agg(pick.alias("v")).first()[0]
        return None if found is None else (found[0], found[1])

    def arg_max_row(self, column: str) -> tuple[int, Any] | None:
        """(row index, value) of the greatest value, the first of ties; None if there is none. NaN is greatest."""
        return self._arg(column, True)

    def arg_min_row(self, column: str) -> tuple[int, Any] | None:
        return self._arg(column, False)

    def top_k_frame(self, column: str, k: int) -> DataFrame:
        """(value, count) of the k most frequent non-null values, as a frame."""
        counts = self.df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        kind = logical(self.df.schema[column].dataType)
        v = F.col("value")
        # Ties: non-negative numbers first, then negative ones, each by size; texts and booleans as they sort.
        ties = [(v < 0).asc(), F.abs(v).asc()] if kind and kind.numeric else [v.asc()]
        return counts.orderBy(F.desc("count"), *ties).limit(k)

    def top_k_by_frequency(self, column: str, k: int) -> list[tuple[Any, int]] | None:
        if column not in self.df.columns:
            return None
        return [(r["value"], r["count"]) for r in self.top_k_frame(column, k).collect()] if k > 0 else []

