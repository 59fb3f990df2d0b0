"""Outliers of one numeric column by z-score, interquartile range or median deviation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.errors import EngineError
from strataline.functions.quantile import order_statistics
from strataline.operators.dataset import Dataset
from strataline.operators.frame import Frame
from strataline.quality.profile import sampled
from strataline.types import col, logical, require

# Names of the methods, their parameter and its default.
METHODS = {"z_score": ("threshold", 3.0), "iqr": ("k", 1.5), "mad": ("threshold", 3.5)}
ALIASES = {"z_score": "z_score", "zscore": "z_score", "iqr": "iqr", "tukey": "iqr", "mad": "mad"}
#: Makes the median deviation comparable with a standard deviation of normal data.
MAD_SCALE = 0.6745


@dataclass(frozen=True)
class Method:
    kind: str
    value: float

    @classmethod
    def of(cls, spec: "Method | dict | str") -> "Method":
        if isinstance(spec, Method):
            return spec
        spec = {"kind": spec} if isinstance(spec, str) else spec
        if "kind" not in spec:
            raise ValueError("outlier method missing 'kind'")
        kind = ALIASES.get(str(spec["kind"]).lower())
        if kind is None:
            raise ValueError("outlier kind must be 'z_score', 'iqr', or 'mad'")
        key, default = METHODS[kind]
        return cls(kind, float(spec.get(key, default)))

    def describe(self) -> str:
        return f"{self.kind}({METHODS[self.kind][0]}={self.value})"


@dataclass(frozen=True)
class OutlierReport:
    column: str
    method: Method
    head: int | None
    row_count: int
    outlier_count: int
    stats: dict[str, float | None]
    examples: list[float] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(
            {
                "column": self.column, "sampling": "Full" if self.head is None else f"Head({self.head})", "row_count": self.row_count,
                "outlier_count": self.outlier_count, "stats": {"method": self.method.describe()} | self.stats, "examples": self.examples,
            },
            indent=2,
        )

    def to_markdown(self) -> str:
        share = self.outlier_count / self.row_count if self.row_count else 0.0
        lines = [f"# Outliers of {self.column}", "", f"{self.outlier_count} of {self.row_count} rows ({share:.4%}) by {self.method.describe()}", ""]
        known = [(k, v) for k, v in self.stats.items() if v is not None]
        lines += ["| statistic | value |", "| --- | --- |", *(f"| {k} | {v:.6f} |" for k, v in known)] if known else []
        lines += ["", "Examples: " + ", ".join(map(str, self.examples))] if self.examples else []
        return "\n".join(lines) + "\n"


STATS = ["mean", "std", "median", "mad", "q1", "q3", "lower_fence", "upper_fence"]


def stats_frame(df: DataFrame, column: str, method: Method) -> DataFrame:
    """One row with row_count and the statistics of the method (others null)."""
    x = col(column).cast("double")
    values = df.select(x.alias("x"))
    base = values.agg(F.count(F.lit(1)).alias("row_count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    none = {s: F.lit(None).cast("double").alias(s) for s in STATS}
    if method.kind == "z_score":
        return base.select("row_count", *[F.col(s) if s in ("mean", "std") else none[s] for s in STATS])
    at = lambda rows, q, how: {r["fraction"]: r["value"] for r in order_statistics(rows, ["x"], q, method=how).collect()}
    found: dict[str, float | None] = dict.fromkeys(STATS)
    if method.kind == "mad":
        found["median"] = at(values, [0.5], "linear").get(0.5)
        if found["median"] is not None:
            found["mad"] = at(values.select(F.abs(F.col("x") - F.lit(found["median"])).alias("x")), [0.5], "linear").get(0.5)
    else:
        marks = at(values, [0.25, 0.75], "nearest")
        if marks:
            width = method.value * (marks[0.75] - marks[0.25])
            found |= {"q1": marks[0.25], "q3": marks[0.75], "lower_fence": marks[0.25] - width, "upper_fence": marks[0.75] + width}
    return base.select("row_count", *[F.lit(found[s]).cast("double").alias(s) for s in STATS])


def outlying(x: Column, method: Method, stats: dict[str, Any]) -> Column:
    """Condition of outlying values; degenerate statistics give none."""
    at = lambda k: F.lit(stats[k])
    if method.kind == "z_score":
        return F.abs((x - at("mean")) / at("std")) > F.lit(method.value) if stats["std"] else F.lit(False)
    if method.kind == "mad":
        return F.lit(MAD_SCALE) * F.abs(x - at("median")) / at("mad") > F.lit(method.value) if stats["mad"] else F.lit(False)
    return (x < at("lower_fence")) | (x > at("upper_fence")) if stats["q1"] is not None and stats["q3"] is not None else F.lit(False)


def detect(data: Dataset | Frame | DataFrame, column: str, method: Method | dict | str, *, head: int | None = None, max_examples: int = 5) -> OutlierReport:
    """The outlier report of a numeric column; nulls are counted as rows and never outlying."""
    method = Method.of(method)
    df = sampled(data, head)
    require(df, column)
    kind = logical(df.schema[column].dataType)
    if kind is None or not kind.numeric:
        raise EngineError(f"column '{column}' is not numeric")
    one = stats_frame(df, column, method).first().asDict()
    rows = one.pop("row_count")
    x = col(column).cast("double")
    flagged = df.filter(outlying(x, method, one))
    count = flagged.count()
    order = data.order_by if isinstance(data, Dataset) else None
    examples = [float(r[0]) for r in Dataset(flagged.select(x.alias("x"), *[col(k) for k in order or []]), order_by=order).head(max_examples).collect()] if count and max_examples > 0 else []
    return OutlierReport(column, method, head, rows, count, one, examples)
