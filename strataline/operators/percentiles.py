"""Exact percentiles per group over very many values (problem 3).

Full distributed sort with per-partition counts: the values are range-partitioned by (group, value) and
sorted inside the partitions, so a group of any size is spread over as many tasks as it needs. Counts per
(partition, group) give each group's offsets; from them follow the partitions that hold the wanted order
statistics; only those are looked at again, and neighbouring order statistics are interpolated. The
result is exact: the stated rank error is 0 and the value error is that of one double interpolation.

Partial results are *value counts*: one row per (group..., part, value) with ``n``. They can be stored per
day, united and asked again, always giving the percentiles of the united data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.common import running_total, sort_join, stage


def value_counts(df: DataFrame, groups: Sequence[str], part: str, value: str) -> DataFrame:
    """The mergeable partial result: rows per (groups, part, value).

    Values that are no numbers (null, NaN, infinite) are left out; negative numbers and zero stay. Integers stay integers, so those
    that doubles cannot hold are told apart. A null group is a group. Empty input gives an empty table.
    """
    if isinstance(df.schema[value].dataType, T.IntegralType):
        known = df.select(*groups, F.col(part).alias("part"), F.col(value).cast("bigint").alias("value")).filter("value is not null")
    else:
        # Adding 0 turns -0 into 0.
        known = df.select(*groups, F.col(part).alias("part"), (F.col(value).cast("double") + F.lit(0.0)).alias("value"))
        known = known.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))))
    return known.groupBy(*groups, "part", "value").agg(F.count(F.lit(1)).alias("n"))


def combine(*partials: DataFrame) -> DataFrame:
    """Unite partial results of separate partitions or days. Nothing is moved: equal values of several
    parts meet in the sort of :func:`percentiles`."""
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out


def percentiles(partial: DataFrame, groups: Sequence[str], fractions: Sequence[float], *, method: str = "linear", partitions: int | None = None) -> DataFrame:
    """Percentiles of each group: columns groups, ``fraction``, ``value``, ``n`` (values in the group),
    ``rank_error`` (0, the order statistics are exact) and the order statistics ``lower`` and ``upper`` that the value lies between.

    The percentile p of n sorted values is the linear interpolation at position (n-1)*p, as in SQL's
    PERCENTILE_CONT, a double; with ``method="nearest"`` it is the value at the nearest position, halves upwards, of the values' type. Groups without a number give no rows. Fractions must lie in 0 to 1.
    """
    if any(not 0 <= p <= 1 for p in fractions):
        raise ValueError("fractions must lie between 0 and 1")
    groups, spark = list(groups), partial.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in groups]
    ordered = stage(
        partial.select(*groups, "value", "n")
        .repartitionByRange(parts, *keys, F.col("value"))
        .sortWithinPartitions(*groups, "value")
        .withColumn("pid", F.spark_partition_id())
        .withColumn("pos", F.monotonically_increasing_id())
    )
    # Null-safe group identity for the joins below.
    gid = F.to_json(F.struct(*keys)) if groups else F.lit("")
    tagged = ordered.withColumn("gid", gid)
    # One row per (partition, group): partitions + groups rows at most, whatever the number of values.
    counts = stage(ordered.groupBy(*groups, "pid").agg(F.sum("n").alias("held")).withColumn("gid", gid))
    offsets = running_total(counts, ["gid"], ["pid"], "held", "offset").withColumn("total", F.sum("held").over(Window.partitionBy("gid")))
    wanted = offsets.withColumn("fraction", F.explode(F.array(*[F.lit(float(p)) for p in fractions])))
    at = (F.col("total") - 1) * F.col("fraction")
    ranks = F.array(F.floor(at + 0.5)) if method == "nearest" else F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    wanted = wanted.withColumn("rank", F.explode(ranks)).filter(
        (F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("held"))
    )
    # Only partitions holding a wanted position are scanned again; a (partition, group) slice is bounded by
    # the partition's size.
    slices = wanted.select("gid", "pid", "offset").distinct()
    # Positions and slices are as many as groups, so they are never broadcast.
    near = running_total(sort_join(tagged.select("gid", "pid", "pos", "value", "n"), slices, ["gid", "pid"]), ["gid", "pid"], ["pos"], "n", "before")
    low = F.col("offset") + F.col("before")
    spans = near.select("gid", "pid", low.alias("low"), (low + F.col("n")).alias("high"), "value")
    hits = sort_join(wanted.select("gid", "pid", *groups, "total", "fraction", "rank"), spans, ["gid", "pid"]).filter(
        (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    share = (F.first("total") - 1) * F.col("fraction")
    under, over = F.min_by("value", "rank"), F.max_by("value", "rank")
    # The nearest value is taken as it is: between two infinite ones the difference is NaN.
    real = lambda x: x.cast("double")
    between = under if method == "nearest" else F.when(under == over, real(under)).otherwise(real(under) + (real(over) - real(under)) * (share - F.floor(share)))
    return (
        hits.groupBy("gid", *groups, "fraction")
        .agg(between.alias("value"), F.first("total").alias("n"), under.alias("lower"), over.alias("upper"))
        .select(*groups, "fraction", "value", "n", F.lit(0).cast("bigint").alias("rank_error"), "lower", "upper")
    )
