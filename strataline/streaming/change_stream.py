"""Change feeds and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataline.operators.change_feed import KEY, touches

_TABLE = ["source", "table_name"]


def _state(spark: SparkSession, state_path: str, number: int) -> tuple[DataFrame, DataFrame] | None:
    """(newest touch of every row, last truncation of every table) after a batch; None before the first."""
    if number < 0:
        return None
    return spark.read.parquet(f"{state_path}/{number}/rows"), spark.read.parquet(f"{state_path}/{number}/cuts")


def merge_batch(batch: DataFrame, before: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """The state after one more batch of events: per row the newest touch in commit order, tombstones included, so that a late
    older change cannot bring a row back; per table the last truncation, which drops what lies before it."""
    rows, cuts = touches(batch)
    rows = rows.select(*KEY, "ord", "writes", "checkpoint_token")
    if before:
        rows, cuts = rows.unionByName(before[0]), cuts.unionByName(before[1])
    cuts = cuts.groupBy(*_TABLE).agg(F.max("cut_at").alias("cut_at"))
    newest = F.max_by(F.struct("ord", "writes", "checkpoint_token"), F.struct("ord", "writes")).alias("t")
    kept = rows.join(cuts, _TABLE, "left").filter("cut_at is null or ord > cut_at").groupBy(*KEY).agg(newest)
    return kept.select(*KEY, "t.*"), cuts


def follow_changes(events: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the current rows of every table from a stream of change events, in any order of arrival.

    A micro-batch is merged into the state of the batch before it and written under its own number, so a repeated batch
    rewrites its own; the state before it is kept, older ones are removed. What is moved is bounded by the rows of the tables and the batch, not by the feed's history.
    The query ends with the data that is there.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        rows, cuts = merge_batch(batch.persist(), _state(spark, state_path, number - 1))
        rows.write.mode("overwrite").parquet(f"{state_path}/{number}/rows")
        cuts.write.mode("overwrite").parquet(f"{state_path}/{number}/cuts")
        batch.unpersist()
        # A restart repeats at most this batch, from the state before it; older states are not needed.
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, state_path: str, number: int) -> DataFrame:
    """The rows that exist after a batch."""
    return _state(spark, state_path, number)[0].filter("writes").select(*KEY, "checkpoint_token")


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and keys; on a stream, data later than ``late`` is dropped by the watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
