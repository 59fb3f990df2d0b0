"""Boundary types of change data capture."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession


class CdcOp(Enum):
    INSERT = "insert"
    UPDATE = "update"
    DELETE = "delete"
    TRUNCATE = "truncate"


@dataclass(frozen=True)
class TableRef:
    name: str
    schema: str | None = None

    @classmethod
    def with_schema(cls, schema: str, name: str) -> "TableRef":
        return cls(name, schema)


@dataclass(frozen=True)
class CdcCheckpoint:
    """An opaque position in the source."""

    token: str


@dataclass(frozen=True)
class SourceMeta:
    source: str | None = None
    checkpoint: CdcCheckpoint | None = None


@dataclass(frozen=True)
class RowImage:
    """Ordered (column, value) pairs."""

    values: Sequence[tuple[str, Any]] = field(default_factory=tuple)

    @classmethod
    def new(cls, values: Iterable[tuple[str, Any]]) -> "RowImage":
        return cls(tuple(values))


@dataclass(frozen=True)
class CdcEvent:
    meta: SourceMeta
    table: TableRef
    op: CdcOp
    before: RowImage | None = None
    after: RowImage | None = None


class CdcSource(Protocol):
    """Batches of events; None ends the feed."""

    def next_batch(self) -> list[CdcEvent] | None: ...


EVENT_COLUMNS = (
    "event_no bigint, meta struct<source:string,checkpoint:string>, table_ref struct<schema_name:string,name:string>, op string, "
    "before array<struct<field_name:string,field_value:string>>, after array<struct<field_name:string,field_value:string>>"
)


def batches(source: CdcSource) -> Iterator[list[CdcEvent]]:
    while (batch := source.next_batch()) is not None:
        yield batch


def to_frame(spark: SparkSession, events: Iterable[CdcEvent], first_no: int = 1) -> DataFrame:
    """Events as rows for :func:`strataline.operators.change_feed.apply_changes`; values become text."""
    image = lambda x: None if x is None else [(n, None if v is None else str(v)) for n, v in x.values]
    rows = [
        (i, (e.meta.source, e.meta.checkpoint and e.meta.checkpoint.token), (e.table.schema, e.table.name), e.op.value, image(e.before), image(e.after))
        for i, e in enumerate(events, first_no)
    ]
    return spark.createDataFrame(rows, EVENT_COLUMNS)
