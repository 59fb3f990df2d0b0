"""Frame: a lazy pipeline over a Spark DataFrame with strict names and explicit null and type rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.errors import EngineError, SchemaMismatch, translated
from strataline.functions.aggregates import Agg, build, parse_reduce_op, variance_kind
from strataline.types import DataType, Schema, canonical, col, logical, quote, require, schema_of

# Kinds of joins.
JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def literal(value: Any) -> Column:
    """A typed literal; null has no type and is refused."""
    if value is None:
        raise EngineError("a null literal has no type")
    if isinstance(value, bool):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("bigint")
    if isinstance(value, float):
        return F.lit(value).cast("double")
    return F.lit(str(value))


class Frame:
    """Every method returns a new Frame; nothing runs before a result is asked for. Missing columns raise at once."""

    def __init__(self, df: DataFrame):
        self.df = canonical(df)

    def __repr__(self) -> str:
        return f"Frame({', '.join(f'{n}: {t}' for n, t in self.df.dtypes)})"

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def _numeric(self, name: str) -> Column:
        require(self.df, name)
        kind = logical(self.df.schema[name].dataType)
        if kind is None or not kind.numeric:
            raise EngineError(f"column '{name}' is not numeric")
        return col(name).cast("double")

    # Predicates

    def filter_eq(self, column: str, value: Any) -> "Frame":
        """Rows equal to the value; null asks for null cells."""
        require(self.df, column)
        return Frame(self.df.filter(col(column).isNull() if value is None else col(column) == literal(value)))

    def filter_not_null(self, column: str) -> "Frame":
        require(self.df, column)
        return Frame(self.df.filter(col(column).isNotNull()))

    def filter_mod_eq_int64(self, column: str, modulus: int, equals: int) -> "Frame":
        """Rows whose remainder (sign of the dividend) equals; modulus 0 keeps none."""
        require(self.df, column)
        return Frame(self.df.filter(F.try_mod(col(column), F.lit(modulus).cast("bigint")) == F.lit(equals).cast("bigint")))

    def filter(self, predicate: Column | str) -> "Frame":
        with translated("filter"):
            return Frame(self.df.filter(predicate))

    # Columns

    def select(self, columns: Sequence[str]) -> "Frame":
        require(self.df, *columns)
        return Frame(self.df.select(*[col(c) for c in columns]))

    def rename(self, pairs: Sequence[tuple[str, str]]) -> "Frame":
        """All at once; a missing column raises."""
        require(self.df, *[a for a, _ in pairs])
        names = dict(pairs)
        out = [names.get(c, c) for c in self.df.columns]
        if len(set(out)) < len(out):
            raise SchemaMismatch(f"rename gives repeated column names: {out}")
        return Frame(self.df.select(*[col(c).alias(names.get(c, c)) for c in self.df.columns]))

    def drop(self, columns: Sequence[str]) -> "Frame":
        require(self.df, *columns)
        return Frame(self.df.select(*[col(c) for c in self.df.columns if c not in set(columns)]))

    def cast(self, column: str, to: str | DataType, mode: str = "strict") -> "Frame":
        """Strict casts fail when run, lossy ones give null."""
        require(self.df, column)
        if mode not in ("strict", "lossy"):
            raise ValueError("cast mode must be 'strict' or 'lossy'")
        target = DataType.parse(to).spark
        return self._with(column, col(column).cast(target) if mode == "strict" else col(column).try_cast(target))

    cast_with_mode = cast

    def _with(self, name: str, value: Column) -> "Frame":
        if name in self.df.columns:
            return Frame(self.df.select(*[value.alias(c) if c == name else col(c) for c in self.df.columns]))
        return Frame(self.df.select(*[col(c) for c in self.df.columns], value.alias(name)))

    def fill_null(self, column: str, value: Any) -> "Frame":
        require(self.df, column)
        return self._with(column, F.coalesce(col(column), literal(value)))

    def with_literal(self, name: str, value: Any) -> "Frame":
        return self._with(name, literal(value))

    def multiply_f64(self, column: str, factor: float) -> "Frame":
        return self._with(column, self._numeric(column) * F.lit(float(factor)))

    def add_f64(self, column: str, delta: float) -> "Frame":
        return self._with(column, self._numeric(column) + F.lit(float(delta)))

    def with_mul_f64(self, name: str, source: str, factor: float) -> "Frame":
        return self._with(name, self._numeric(source) * F.lit(float(factor)))

    def with_add_f64(self, name: str, source: str, delta: float) -> "Frame":
        return self._with(name, self._numeric(source) + F.lit(float(delta)))

    # Joins and groups

    def join(self, other: "Frame", left_on: Sequence[str], right_on: Sequence[str], how: str = "inner") -> "Frame":
        """Equi-join. Columns: the left ones, then the right ones but the keys; clashing names get ``_right``.

        Keys keep the left names; right joins take the right side's values, full joins whichever is there. Null keys
        match nothing. Which algorithm runs is left to the optimiser.
        """
        if not left_on or len(left_on) != len(right_on):
            raise SchemaMismatch("a join needs as many left as right keys, at least one")
        if how not in JOIN_KINDS:
            raise ValueError(f"unknown join kind '{how}'; expected inner, left, right, or full")
        require(self.df, *left_on)
        require(other.df, *right_on)
        l, r = self.df.alias("__l"), other.df.alias("__r")
        left, right = (lambda c: F.col(f"__l.{quote(c)}")), (lambda c: F.col(f"__r.{quote(c)}"))
        on = [left(a) == right(b) for a, b in zip(left_on, right_on, strict=True)]
        pair, out = dict(zip(left_on, right_on, strict=True)), []
        for c in self.df.columns:
            value = left(c)
            if c in pair and how == "right":
                value = right(pair[c])
            elif c in pair and how == "full":
                value = F.coalesce(left(c), right(pair[c]))
            out.append(value.alias(c))
        taken = set(self.df.columns)
        for c in other.df.columns:
            if c not in right_on:
                name = c
                while name in taken:
                    name += "_right"
                taken.add(name)
                out.append(right(c).alias(name))
        return Frame(l.join(r, on, JOIN_KINDS[how]).select(*out))

    def group_by(self, keys: Sequence[str], aggs: Sequence[Agg | dict]) -> "Frame":
        """Null keys form a group of their own; the order of the result is not defined."""
        if not keys or not aggs:
            raise SchemaMismatch("group_by needs at least one key and one aggregate")
        specs = [Agg.of(a) for a in aggs]
        require(self.df, *keys, *[a.column for a in specs if a.column])
        return Frame(self.df.groupBy(*[col(k) for k in keys]).agg(*[a.expression(self.df) for a in specs]))

    # Results

    def collect(self):
        """The result as an in-memory Dataset; unsupported types raise."""
        from strataline.operators.dataset import Dataset

        return Dataset(self.df, schema_of(self.df))

    def collect_with_schema(self, schema):
        """The columns of ``schema``, in its order, cast lossily."""
        from strataline.operators.dataset import Dataset

        schema = Schema.of(schema)
        require(self.df, *schema.names)
        return Dataset(self.df.select(*[col(f.name).try_cast(f.data_type.spark).alias(f.name) for f in schema.fields]), schema)

    def reduce_frame(self, column: str, op: str) -> DataFrame:
        """One row with the reduction as ``value``."""
        return self.df.agg(build(parse_reduce_op(op), self.df, column, "frame").alias("value"))

    def reduce(self, column: str, op: str) -> Any:
        """A scalar; None also for an unknown column."""
        if column not in self.df.columns:
            return None
        with translated("reduce"):
            return self.reduce_frame(column, op).collect()[0][0]

    def sum(self, column: str) -> Any:
        return self.reduce(column, "sum")

    def feature_stats(self, columns: Sequence[str], std_kind: str | None = None) -> DataFrame:
        """(column, mean, std) of several columns in one scan."""
        require(self.df, *columns)
        kind = variance_kind(std_kind)
        exprs = [e.alias(f"{i}_{k}") for i, c in enumerate(columns) for k, e in (("m", build("mean", self.df, c)), ("s", build(f"std_{kind}", self.df, c)))]
        one = self.df.agg(*exprs)
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{i}_m").alias("mean"), F.col(f"{i}_s").alias("std")) for i, c in enumerate(columns)])
        return one.select(F.inline(rows))

    def feature_wise_mean_std(self, columns: Sequence[str], std_kind: str | None = None) -> dict[str, dict[str, float | None]]:
        return {r["column"]: {"mean": r["mean"], "std": r["std"]} for r in self.feature_stats(columns, std_kind).collect()}

    # Beyond the usual pipeline: sorting, limits and set operations with explicit rules.

    def sort(self, *keys: tuple[str, bool]) -> "Frame":
        """Order by (column, ascending) pairs, nulls last."""
        require(self.df, *[k for k, _ in keys])
        return Frame(self.df.orderBy(*[col(k).asc_nulls_last() if up else col(k).desc_nulls_last() for k, up in keys]))

    def limit(self, n: int) -> "Frame":
        return Frame(self.df.limit(n))

    def union(self, other: "Frame") -> "Frame":
        """Rows of both, by column name."""
        return Frame(self.df.unionByName(other.df))
