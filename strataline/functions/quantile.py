"""Exact order statistics of columns without sorting them.

A quantile sketch brackets each wanted position; one more pass counts what lies below a bracket and inside it. Brackets that
still hold many values are narrowed in the same way, so what is ranked at last is small whatever the column holds.
Comparisons are made as doubles, which never reverses the order of integers; the values ranked are the column's own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.types import col

#: Accuracy of the sketch; values of a bracket that are ranked in one task.
ACCURACY, RANKED = 10_000, 100_000


@dataclass
class _Bracket:
    """Where the value at a position (from 0) of a column lies: at or between two doubles."""

    column: str
    fraction: float
    rank: int
    lo: float = -math.inf
    hi: float = math.inf
    below: int = 0
    inside: int = 0


def _real(df: DataFrame, name: str):
    """A column as double for comparisons; null where it holds no number."""
    x = col(name).cast("double")
    return F.when(~F.isnan(x), x)


def _within(df: DataFrame, b: _Bracket):
    x = _real(df, b.column)
    return (x >= F.lit(b.lo)) & (x <= F.lit(b.hi))


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> None:
    """One pass of sketches over what is in each bracket, one pass of counts."""
    # Brackets of one column that are still the same range share a sketch.
    ranges: dict[tuple, list[int]] = {}
    for i, b in enumerate(brackets):
        ranges.setdefault((b.column, b.lo, b.hi), []).append(i)
    wanted = []
    for k, members in enumerate(ranges.values()):
        b = brackets[members[0]]
        at = [(brackets[i].rank - b.below) / max(1, b.inside - 1) for i in members]
        around = [min(1.0, max(0.0, x + d)) for x in at for d in (-4 / ACCURACY, 4 / ACCURACY)]
        x = _real(df, b.column) if (b.lo, b.hi) == (-math.inf, math.inf) else F.when(_within(df, b), _real(df, b.column))
        wanted.append(F.percentile_approx(x, F.array(*map(F.lit, around)), F.lit(ACCURACY)).alias(f"r{k}"))
    found = df.agg(*wanted).first()
    ends = {i: found[f"r{k}"][2 * j : 2 * j + 2] for k, members in enumerate(ranges.values()) for j, i in enumerate(members)}
    tried = [_Bracket(b.column, b.fraction, b.rank, *ends[i]) for i, b in enumerate(brackets)]
    counts = df.agg(
        *[F.count_if(_real(df, t.column) < F.lit(t.lo)).alias(f"l{i}") for i, t in enumerate(tried)], *[F.count_if(_within(df, t)).alias(f"n{i}") for i, t in enumerate(tried)]
    ).first()
    for i, (b, t) in enumerate(zip(brackets, tried, strict=True)):
        # A bracket that misses its position, or cuts nothing off, is not taken.
        if counts[f"l{i}"] <= b.rank < counts[f"l{i}"] + counts[f"n{i}"] and counts[f"n{i}"] < b.inside:
            b.lo, b.hi, b.below, b.inside = t.lo, t.hi, counts[f"l{i}"], counts[f"n{i}"]


def _places(n: int, q: float, method: str) -> list[int]:
    at = (n - 1) * q
    return [math.floor(at + 0.5)] if method == "nearest" else sorted({math.floor(at), math.ceil(at)})


def order_statistics(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], *, method: str = "nearest") -> DataFrame:
    """(column, fraction, value, n) of numeric columns of one kind (all integers or all floating); nulls and NaN are left out and
    columns without numbers give no rows.

    ``nearest``: the value at index floor((n-1)q + 0.5) of the sorted values, of the column's own type. ``linear``: a double,
    interpolated between the neighbouring values. Both are exact. The driver holds a few numbers a column.
    """
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in columns)
    kind = "bigint" if whole and method == "nearest" else "double"
    empty = df.sparkSession.createDataFrame([], f"column string, fraction double, value {kind}, n bigint")
    if not columns or not fractions:
        return empty
    df = df.select(*[col(c).alias(c) for c in dict.fromkeys(columns)])
    held = df.agg(*[F.count(_real(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    totals = {c: held[f"c{i}"] for i, c in enumerate(columns) if held[f"c{i}"]}
    brackets = [_Bracket(c, float(q), r, inside=n) for c, n in totals.items() for q in dict.fromkeys(fractions) for r in _places(n, q, method)]
    if not brackets:
        return empty
    many = [b for b in brackets if b.inside > RANKED]
    while many:
        before = [b.inside for b in many]
        _narrow(df, many)
        # What cannot be narrowed is one value, or integers that are one double; the counts below compress both.
        many = [b for b, was in zip(many, before, strict=True) if RANKED < b.inside < was]
    own = "bigint" if whole else "double"
    cells = [
        F.struct(F.lit(i).alias("i"), F.when(_within(df, b), col(b.column).cast(own)).alias("value"))
        for i, b in enumerate(brackets)
    ]
    inside = F.filter(F.array(*cells), lambda c: c["value"].isNotNull())
    near = df.select(F.inline(inside)).groupBy("i", "value").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    places = df.sparkSession.createDataFrame([(i, b.column, b.fraction, b.rank, b.below, totals[b.column]) for i, b in enumerate(brackets)], "i int, column string, fraction double, rank bigint, below bigint, n bigint")
    hits = near.withColumn("upto", upto).join(F.broadcast(places), "i").filter("rank - below < upto and rank - below >= upto - m")
    if method == "nearest":
        return hits.select("column", "fraction", "value", "n")
    share = (F.first("n") - 1) * F.col("fraction")
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    between = F.when(low == high, low.cast("double")).otherwise(low + (high - low) * (share - F.floor(share)))
    return hits.groupBy("column", "fraction").agg(between.alias("value"), F.first("n").alias("n"))
