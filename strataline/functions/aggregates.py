"""Aggregates under two modes: ``dataset`` (text columns and empty sums give null) and ``frame`` (empty sums give 0,
text columns are errors)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.errors import EngineError
from strataline.types import col, logical

# Names of the reductions and the operation they stand for.
REDUCE_OPS = {
    "count": "count", "sum": "sum", "min": "min", "max": "max", "mean": "mean",
    "variance_population": "var_pop", "var_pop": "var_pop",
    "variance_sample": "var_samp", "var_sample": "var_samp",
    "stddev_population": "std_pop", "std_pop": "std_pop", "std_dev_population": "std_pop",
    "stddev_sample": "std_samp", "std_sample": "std_samp", "std_dev_sample": "std_samp",
    "sum_squares": "sumsq", "sumsq": "sumsq",
    "l2_norm": "l2", "l2": "l2",
    "count_distinct_non_null": "distinct", "count_distinct": "distinct",
}

# Names of the grouped aggregates.
GROUP_OPS = {
    "count_rows": "count", "count_not_null": "count_not_null", "sum": "sum", "min": "min", "max": "max", "mean": "mean",
    "variance": "var", "std_dev": "std", "stddev": "std", "sum_squares": "sumsq", "l2_norm": "l2", "l2": "l2",
    "count_distinct_non_null": "distinct", "count_distinct": "distinct",
}

# Names of the two kinds of variance.
VARIANCE_KINDS = {"population": "pop", "pop": "pop", "sample": "samp"}


def parse_reduce_op(name: str) -> str:
    op = REDUCE_OPS.get(name.lower().replace("-", "_"))
    if op is None:
        raise ValueError(f"unknown reduce op '{name}'")
    return op


def variance_kind(name: str | None) -> str:
    kind = VARIANCE_KINDS.get((name or "sample").lower())
    if kind is None:
        raise ValueError("std_kind must be 'population' or 'sample'")
    return kind


def _extreme(fn, c: Column, t: T.DataType) -> Column:
    """Least or greatest ignoring NaN, NaN only if there is nothing else."""
    if isinstance(t, T.FloatType | T.DoubleType):
        return F.coalesce(fn(F.when(~F.isnan(c), c)), fn(c))
    return fn(c)


def build(op: str, df: DataFrame, name: str, mode: str = "frame") -> Column:
    """The aggregate expression of one operation over a column of ``df``."""
    if op == "count":
        return F.count(F.lit(1))
    t, c = df.schema[name].dataType, col(name)
    kind = logical(t)
    if op == "count_not_null":
        return F.count(c)
    if op == "distinct":
        return F.count_distinct(c)
    if kind is None or not kind.numeric:
        if mode == "dataset":
            return F.lit(None).cast("double")
        if op in ("min", "max") and kind is not None:
            return getattr(F, op)(c)
        raise EngineError(f"'{op}' needs a numeric column; '{name}' is {t.simpleString()}")
    x = c.cast("double")
    if op == "sum":
        total = F.sum(c.cast(kind.spark))
        return F.coalesce(total, F.lit(0).cast(kind.spark)) if mode == "frame" else total
    if op in ("min", "max"):
        return _extreme(getattr(F, op), c.cast(kind.spark), kind.spark)
    return {
        "mean": lambda: F.avg(x), "var_pop": lambda: F.var_pop(x), "var_samp": lambda: F.var_samp(x),
        "std_pop": lambda: F.stddev_pop(x), "std_samp": lambda: F.stddev_samp(x),
        "sumsq": lambda: F.sum(x * x), "l2": lambda: F.sqrt(F.sum(x * x)),
    }[op]()


@dataclass(frozen=True)
class Agg:
    """One grouped aggregate: operation, column (none for count_rows), alias, kind of variance."""

    op: str
    alias: str
    column: str | None = None
    kind: str = "sample"

    @classmethod
    def of(cls, spec: "Agg | dict") -> "Agg":
        if isinstance(spec, Agg):
            return spec
        name = str(spec.get("type", "")).lower().replace("-", "_")
        if name not in GROUP_OPS:
            raise ValueError(f"unknown aggregation type '{spec.get('type')}'")
        need = ["alias"] if name == "count_rows" else ["alias", "column"]
        for key in need:
            if key not in spec:
                raise ValueError(f"missing '{key}'")
        return cls(name, spec["alias"], spec.get("column"), spec.get("kind") or "sample")

    def expression(self, df: DataFrame) -> Column:
        op = GROUP_OPS.get(self.op)
        if op is None:
            raise ValueError(f"unknown aggregation type '{self.op}'")
        if op in ("var", "std"):
            op = f"{op}_{variance_kind(self.kind)}"
        return build(op, df, self.column, "frame").alias(self.alias)
