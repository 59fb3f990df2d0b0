"""The four logical types, schemas, and safe column names."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.errors import SchemaMismatch


class DataType(Enum):
    INT64 = "int64"
    FLOAT64 = "float64"
    BOOL = "bool"
    UTF8 = "utf8"

    @property
    def spark(self) -> T.DataType:
        return {DataType.INT64: T.LongType(), DataType.FLOAT64: T.DoubleType(), DataType.BOOL: T.BooleanType(), DataType.UTF8: T.StringType()}[self]

    @property
    def title(self) -> str:
        return self.value.capitalize()

    @property
    def numeric(self) -> bool:
        return self in (DataType.INT64, DataType.FLOAT64)

    @classmethod
    def parse(cls, text: "str | DataType") -> "DataType":
        if isinstance(text, cls):
            return text
        found = ALIASES.get(text.strip().lower())
        if found is None:
            raise ValueError(f"unknown data_type '{text}'; expected int64, float64, bool, or utf8")
        return cls(found)


# Accepted names of the types.
ALIASES = {
    "int64": "int64", "i64": "int64",
    "float64": "float64", "f64": "float64", "double": "float64",
    "bool": "bool", "boolean": "bool",
    "utf8": "utf8", "string": "utf8", "str": "utf8", "text": "utf8",
}


def quote(name: str) -> str:
    """A column name that Spark takes literally, dots and back quotes included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


@dataclass(frozen=True)
class Field:
    name: str
    data_type: DataType


@dataclass(frozen=True)
class Schema:
    """Ordered fields, all nullable. Names are matched exactly; the first of equal names counts."""

    fields: tuple[Field, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, spec: "Schema | Iterable") -> "Schema":
        """From a schema, (name, type) pairs, or dicts with ``name`` and ``data_type``."""
        if isinstance(spec, Schema):
            return spec
        out = []
        for item in spec:
            if isinstance(item, Field):
                out.append(item)
            elif isinstance(item, dict):
                for key in ("name", "data_type"):
                    if key not in item:
                        raise ValueError(f"schema field missing '{key}'")
                out.append(Field(item["name"], DataType.parse(item["data_type"])))
            else:
                out.append(Field(item[0], DataType.parse(item[1])))
        return cls(tuple(out))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def index_of(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.fields) if f.name == name), None)

    def type_of(self, name: str) -> DataType | None:
        at = self.index_of(name)
        return None if at is None else self.fields[at].data_type

    def to_struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.data_type.spark, True) for f in self.fields])

    def to_list(self) -> list[dict]:
        return [{"name": f.name, "data_type": f.data_type.value} for f in self.fields]


def logical(t: T.DataType) -> DataType | None:
    """The logical type a physical one widens to; None if there is none."""
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return DataType.INT64
    if isinstance(t, T.FloatType | T.DoubleType):
        return DataType.FLOAT64
    if isinstance(t, T.BooleanType):
        return DataType.BOOL
    if isinstance(t, T.StringType):
        return DataType.UTF8
    return None


def schema_of(df: DataFrame, *, strict: bool = True) -> Schema:
    """Schema of a frame. Other types raise if strict, else count as text."""
    out = []
    for f in df.schema.fields:
        t = logical(f.dataType)
        if t is None and strict:
            raise SchemaMismatch(f"column '{f.name}' has the unsupported type {f.dataType.simpleString()}")
        out.append(Field(f.name, t or DataType.UTF8))
    return Schema(tuple(out))


def canonical(df: DataFrame) -> DataFrame:
    """Narrow numbers widened to bigint and double; other columns pass through."""
    cols = []
    for f in df.schema.fields:
        t = logical(f.dataType)
        c = col(f.name)
        cols.append(c.cast(t.spark).alias(f.name) if t and t.spark != f.dataType else c)
    return df.select(*cols)


def require(df: DataFrame, *names: str) -> None:
    """Raise unless the frame has these columns, letter case included."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing column(s) {', '.join(repr(m) for m in missing)}; have {df.columns}")
