"""Implausible readings per source (problem 5): impossible values, stuck values, spikes.

Spikes: the successful readings of a source become a daily profile matrix (days x order statistics of the
logarithm). Robust principal components (principal component pursuit, solved for many sources at once)
split it into a low-rank part, the source's normal days including lasting changes of level and slow growth,
and a sparse part. The sparse part names the days that hold spikes, the low-rank part the readings on them that stand out. A check
follows: they must lie beyond a gap of a factor of three from all ordinary readings; readings that recur are
ordinary. Stuck values and ranges are tested apart.

A source of any size is reduced map-side to days and value bins before one row per source is formed, and
the series is cut by range partitioning, so no task holds a whole hot source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.common import salted_lookup, stage

#: Least runs of a source to have a normal behaviour; least equal readings in a row; least factor between a
#: spike and ordinary readings (stated as "about three"); readings beyond a gap count as recurring
#: when they are more than RECUR_RUNS and more than RECUR_SHARE of the source's.
MIN_RUNS, STUCK_RUNS, FACTOR, RECUR_RUNS, RECUR_SHARE = 40, 6, 2.9, 3, 0.053
#: Order statistics of a day's readings that form its profile, beside the least and the greatest.
PROFILE = [0.3, 0.4, 0.5, 0.6, 0.7]
#: Width of the logarithmic value bins; each keeps its exact least and greatest reading.
BIN = math.log(1.02)
#: Least readings of a row that has inner order statistics of its own; other rows take the usual ones, so that one reading
#: does not fill its whole row. Mean readings of a day from which it is cut into several rows, so that a few spikes among
#: very many readings do not touch every row.
FULL, PER_ROW = 16, 32
#: Rows of one profile matrix; longer series are split into several matrices. Matrices of one stack; rounds of the pursuit.
BLOCK, STACK, ROUNDS = 366, 512, 45
DAY = 86_400_000
#: The middle that profiles of logarithms are moved to: days of another level then lie along one strong component.
LEVEL = 10.0
#: Factor by which the sparse part must lift a row's greatest reading (or push its least) for the row to be named, and by which
#: readings must differ from the row's normal median.
STANDS_OUT = 1.5


def pursuit(x: np.ndarray, days: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Principal component pursuit for a stack of matrices: x = low rank + sparse (augmented Lagrangian).

    ``days`` gives the rows of each matrix that are not padding. The price of sparse entries and the steps depend on the matrix
    alone, so it is split in one way whatever it is stacked with.
    """
    rows = np.full(len(x), x.shape[-2]) if days is None else np.asarray(days)
    lam = 1 / np.sqrt(np.maximum(rows, x.shape[-1]))[:, None, None]
    gram = np.linalg.eigvalsh(np.swapaxes(x, -1, -2) @ x)[..., -1]
    top = np.sqrt(np.maximum(gram, 1e-24))[:, None, None]
    y = x / np.maximum(top, np.abs(x).max(axis=(-2, -1), keepdims=True) / lam)
    mu, sparse, low = 1.25 / top, np.zeros_like(x), np.zeros_like(x)
    for _ in range(ROUNDS):
        a = x - sparse + y / mu
        values, vectors = np.linalg.eigh(np.swapaxes(a, -1, -2) @ a)
        root = np.sqrt(np.maximum(values, 0))[:, None, :]
        keep = np.maximum(root - 1 / mu, 0) / np.maximum(root, 1e-12)
        low = (a @ (vectors * keep)) @ np.swapaxes(vectors, -1, -2)
        b = x - low + y / mu
        sparse = np.sign(b) * np.maximum(np.abs(b) - lam / mu, 0)
        y = y + mu * (x - low - sparse)
        mu = np.minimum(mu * 1.5, 1e7 / top)
    return low, sparse


def _cut(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, total: int) -> float:
    """The least value beyond the lowest gap of FACTOR above the middle of the readings over which few lie; inf if
    there is none. lo, hi, n: bounds and sizes of the occupied bins, ascending."""
    above = np.cumsum(n[::-1])[::-1]
    few = max(RECUR_RUNS, RECUR_SHARE * total)
    gaps = np.flatnonzero((lo[1:] >= FACTOR * hi[:-1]) & (above[1:] <= few) & (above[1:] * 2 < total)) + 1
    return float(lo[gaps[0]]) if len(gaps) else math.inf


def _cuts(bins: np.ndarray, total: int) -> tuple[float, float]:
    """(high, low) ends of the ordinary readings: beyond a gap lie only few."""
    lo, hi, n = bins[np.argsort(bins[:, 0])].T
    down = _cut(1 / hi[::-1], 1 / lo[::-1], n[::-1], total)
    return _cut(lo, hi, n, total), (1 + 1e-9) / down if math.isfinite(down) else 0.0


def _profiles(rows: list[dict]) -> tuple[list[int], np.ndarray, float]:
    """Periods in order, their profiles, one row each, as logarithms about LEVEL, and what was taken off the logarithms."""
    full = [r["middle"] for r in rows if r["n"] >= FULL]
    usual = np.median(np.array(full or [r["middle"] for r in rows], float), axis=0).tolist()
    lines = sorted((r["period"], [r["least"], *(r["middle"] if r["n"] >= FULL else usual), r["most"]]) for r in rows)
    x = np.log(np.array([v for _, v in lines], float))
    return [p for p, _ in lines], x - np.median(x) + LEVEL, float(np.median(x) - LEVEL)


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Periods whose least or greatest reading the pursuit puts into the sparse part, with the readings that stand out from the
    low-rank part of the period's median."""
    step, middle = math.log(STANDS_OUT), 1 + len(PROFILE) // 2
    for pdf in batches:
        blocks = sorted(((i, *_profiles(list(rows))) for i, rows in enumerate(pdf["rows"])), key=lambda b: len(b[1]))
        out = []
        # Matrices of like length are stacked, to pad little.
        for at in range(0, len(blocks), STACK):
            some = blocks[at : at + STACK]
            x = np.zeros((len(some), len(some[-1][1]), len(PROFILE) + 2))
            for z, b in enumerate(some):
                x[z, : len(b[1])] = b[2]
            low, sparse = pursuit(x, np.array([len(b[1]) for b in some]))
            for z, (i, periods, _, level) in enumerate(some):
                high, deep = sparse[z, : len(periods), -1] >= step, sparse[z, : len(periods), 0] <= -step
                normal = np.exp(low[z, : len(periods), middle] + level)
                for d in np.flatnonzero(high | deep):
                    out.append((pdf["source"].iloc[i], periods[d], float(normal[d] * STANDS_OUT) if high[d] else math.inf, float(normal[d] / STANDS_OUT) if deep[d] else 0.0))
        yield pd.DataFrame(out, columns=["source", "period", "high_from", "low_to"])


def _ordinary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cuts = [_cuts(np.array([(b["lo"], b["hi"], b["n"]) for b in bins]), total) for bins, total in zip(pdf["bins"], pdf["total"], strict=True)]
        yield pd.DataFrame({"source": pdf["source"], "high_cut": [c for c, _ in cuts], "low_cut": [c for _, c in cuts]})


def in_periods(readings: DataFrame) -> DataFrame:
    """Possible successful readings of sources of MIN_RUNS readings or more, with their ``period``: a day from the source's first
    one on, or, for sources of more than PER_ROW readings a day, an equal part of one."""
    sources = stage(
        readings.groupBy("source", F.floor(F.col("at") / F.lit(DAY)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source").agg(F.sum("n").alias("runs"), F.min("day").cast("bigint").alias("first"), F.ceil(F.sum("n") / F.count(F.lit(1)) / F.lit(PER_ROW)).cast("bigint").alias("parts"))
        .filter(F.col("runs") >= MIN_RUNS).select("source", "first", "parts")
    )
    good = salted_lookup(readings.filter("ok and possible and value > 0 and source is not null and at is not null"), sources, ["source"], ["id"], how="inner")
    return good.select("source", "id", "value", F.floor((F.col("at") - F.col("first") * DAY) * F.col("parts") / F.lit(DAY)).cast("bigint").alias("period"))


def spikes(readings: DataFrame) -> DataFrame:
    """(source, id) of readings that the sparse part of their source's profiles names and that lie beyond a gap from its
    ordinary readings. ``readings``: source, id, at (ms), value, ok, possible."""
    good = stage(in_periods(readings))
    kept = good.schema["source"]
    block = F.floor(F.col("period") / F.lit(BLOCK)).alias("block")
    rows = good.groupBy("source", "period").agg(
        F.min("value").alias("least"), F.percentile_approx("value", F.array(*[F.lit(p) for p in PROFILE]), F.lit(200)).alias("middle"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n")
    )
    # A block has at most BLOCK rows, whatever its source holds.
    blocks = rows.groupBy("source", block).agg(F.collect_list(F.struct("period", "least", "middle", "most", "n")).alias("rows")).select("source", "rows")
    named = stage(blocks.mapInPandas(_named, T.StructType([kept, *T.StructType.fromDDL("period bigint, high_from double, low_to double").fields])))
    bins = (
        good.groupBy("source", F.floor(F.log("value") / F.lit(BIN)).alias("bin"))
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
        .groupBy("source").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("bins"), F.sum("n").alias("total"))
    )
    cuts = bins.mapInPandas(_ordinary, T.StructType([kept, *T.StructType.fromDDL("high_cut double, low_cut double").fields])).filter("high_cut < double('inf') or low_cut > 0")
    ranges = stage(
        named.join(cuts, "source").select("source", "period", F.greatest("high_from", "high_cut").alias("high_from"), F.least("low_to", "low_cut").alias("low_to"))
        .filter("high_from < double('inf') or low_to > 0")
    )
    return salted_lookup(good, ranges, ["source", "period"], ["id"], how="inner").filter("value >= high_from or value <= low_to").select("source", "id")


def stuck(readings: DataFrame) -> DataFrame:
    """Readings (source, id) that stand unchanged in at least STUCK_RUNS successive successful readings.

    The whole series is range-partitioned by (source, at, id), so a hot source is cut into slices; equal
    stretches are counted within slices and stretches that touch a slice's border are joined over it.
    """
    parts = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = stage(
        readings.filter("ok and value is not null and not isnan(value)").select("source", "at", "id", "value")
        .repartitionByRange(parts, "source", "at", "id").withColumn("pid", F.spark_partition_id())
    )
    w = Window.partitionBy("source", "pid").orderBy("at", "id")
    fresh = (F.lag("value").over(w).isNull() | (F.lag("value").over(w) != F.col("value"))).cast("int")
    marked = series.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    last = F.max("island").over(Window.partitionBy("source", "pid"))
    islands = (
        marked.groupBy("source", "pid", "island").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
        .withColumn("last", last)
    )
    inner = islands.filter((F.col("n") >= STUCK_RUNS)).select("source", "pid", "island")
    # At most two stretches a slice touch its borders.
    border = islands.filter("island = 1 or island = last")
    along = Window.partitionBy("source").orderBy("pid", "island")
    joins = (F.lag("value").over(along) == F.col("value")) & (F.lag("pid").over(along) < F.col("pid")) & (F.col("island") == 1)
    border = border.withColumn("chain", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(along))
    over = border.withColumn("all", F.sum("n").over(Window.partitionBy("source", "chain"))).filter(F.col("all") >= STUCK_RUNS).select("source", "pid", "island")
    return marked.join(inner.unionByName(over).distinct(), ["source", "pid", "island"], "left_semi").select("source", "id")


def implausible(readings: DataFrame) -> DataFrame:
    """(source, id, kind) of implausible readings; kind is impossible, stuck or spike, the first that applies.

    ``readings``: source, id (unique), at (ms), value, ok (successful), most (greatest possible value).
    Impossible: negative, NaN or infinite, 0 though successful, or above ``most``. Null readings are no
    cases and are skipped; rows without a source are tested for impossible values only, those without a time not for spikes; a null ``ok`` is not successful; sources with fewer than MIN_RUNS readings have no
    spikes. Empty input gives no rows.
    """
    v = F.col("value")
    ok = F.coalesce("ok", F.lit(False))
    bad = F.coalesce(v < 0, F.lit(False)) | F.coalesce(F.isnan(v), F.lit(False)) | F.coalesce(F.abs(v) == F.lit(math.inf), F.lit(False)) | F.coalesce((v == 0) & ok, F.lit(False)) | F.coalesce(v > F.col("most"), F.lit(False))
    tested = stage(readings.select("source", "id", "at", "value", ok.alias("ok"), (~bad).alias("possible")))
    found = (
        tested.filter("not possible").select("source", "id", F.lit("impossible").alias("kind"))
        .unionByName(stuck(tested).withColumn("kind", F.lit("stuck")))
        .unionByName(spikes(tested).withColumn("kind", F.lit("spike")))
    )
    return found.groupBy("source", "id").agg(F.min("kind").alias("kind"))
