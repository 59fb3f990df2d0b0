"""Shared helpers: table access, lineage cuts in the shared folder, skew-safe building blocks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STAGE_ROOTS: dict[str, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share.

    The session's ``spark.checkpoint.dir`` decides. Only where it is unset and the master is local
    (tests, notebooks) a temporary folder is made; a cluster without the setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strataline-shared-")
    atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder's owner cleans up then
        pass


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; everything under a session's root is removed when its process ends."""
    app = spark.sparkContext.applicationId
    if app not in _STAGE_ROOTS:
        _STAGE_ROOTS[app] = (spark, f"{checkpoint_root(spark)}/strataline-{app}-{uuid.uuid4().hex[:8]}")
        atexit.register(_remove, *_STAGE_ROOTS[app])
    return f"{_STAGE_ROOTS[app][1]}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove all tables staged so far in this session; for jobs that have written their results. Frames that still read one fail."""
    held = _STAGE_ROOTS.pop(spark.sparkContext.applicationId, None)
    if held:
        _remove(*held)


def stage(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts lineage, survives the loss of executors and keeps columns prunable.
    """
    path = scratch_path(df.sparkSession)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def epoch_micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp column without zone that means UTC, in any session zone."""
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name).cast("timestamp_ntz"))
    return F.unix_micros(utc.cast("timestamp"))


def best_per_key(df: DataFrame, keys: list[str], payload: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest ``order`` for each key, as an aggregate with map-side combine.

    A key that holds a third of all rows shrinks to one row per task before the shuffle, so no window
    over the key's rows is needed. Null keys form one key. Ties in ``order`` are broken by the hash of
    the payload, then by Spark's choice among rows equal in both, which are interchangeable.
    """
    body = F.struct(*payload)
    rank = F.struct(*order, F.xxhash64(*payload))
    picked = df.groupBy(*keys).agg(F.max_by(body, rank).alias("__best"))
    return picked.select(*keys, "__best.*")


def sort_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that sorts both sides and is never broadcast.

    The planner takes compressed files for a table's size and does not count the rows that exploding adds, so what it
    broadcasts through the driver may be many times its threshold. For sides that grow with the input.
    """
    return left.join(right.hint("merge"), keys, how)


#: Most bytes of a staged table, as written and as rows in memory, that is broadcast; bytes of a row besides its text.
BROADCAST_BYTES, ROW_BYTES = 4 << 20, 64


def is_small(staged: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged (or other file) table is known to be small: the size of its files, and of its rows too, because files
    of values that repeat are a small part of them."""
    if int(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > limit:
        return False
    held = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in staged.columns]))) + F.lit(ROW_BYTES)
    return (staged.agg(F.sum(held)).first()[0] or 0) <= limit


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], salt_by: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """Join of ``rows`` with a much smaller ``lookup`` (unique in ``keys``), safe for hot keys; ``how``: left or inner.

    A lookup that is small, written and in memory, is broadcast. Otherwise rows of one key are spread over ``salts`` groups by the hash of
    ``salt_by`` and the lookup is repeated once per salt.
    """
    if is_small(lookup):
        return rows.join(F.broadcast(lookup), keys, how)
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return sort_join(spread, copies, [*keys, "__salt"], how).drop("__salt")


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before this one; for small tables of counts only."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("bigint"))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the group before this one, for groups of any size.

    Rows are range-partitioned by (group, order); sums within (group, partition) are added to the
    group's sums in earlier partitions. ``order`` must be unique in a group for a definite result. Keeps ``pid``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stage(df.repartitionByRange(parts, *group, *order).withColumn("pid", F.spark_partition_id()))
    held = spread.groupBy(*group, "pid").agg(F.sum(value).alias("__held"))
    offsets = running_total(held, group, ["pid"], "__held", "__offset").drop("__held")
    local = running_total(spread, [*group, "pid"], order, value, "__local")
    return local.join(offsets, [*group, "pid"]).withColumn(name, F.col("__local") + F.col("__offset")).drop("__local", "__offset")
