"""Applying a change feed in commit order (problem 7): newest-first resolution.

Changes become *touches*: a touch writes a row or removes it. Batches of touches are taken from the newest
to the oldest; in each the newest touch of a key counts, keys that a newer batch has resolved are
anti-joined away, and what remains is recorded as the row's image or as a tombstone. Base rows whose key was never
touched, in tables never truncated, are appended last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.common import stage

KEY = ["source", "table_name", "row_id"]


def commit_order(checkpoint: Column) -> Column:
    """A checkpoint as text that sorts in commit order within its source; null where nothing can be read.

    Forms: ``hex/hex`` (log position), ``prefix:number`` with a hexadecimal prefix (transaction of a
    server), a UTC time with an optional counter, else all decimal numbers in order (log file and position,
    plain sequence). Numbers are padded to 20 digits, times become microseconds.
    """
    c = F.trim(checkpoint)
    pad = lambda x: F.lpad(x, 20, "0")
    halves = F.split(F.upper(c), "/")
    lsn = F.concat(pad(F.conv(halves[0], 16, 10)), pad(F.conv(halves[1], 16, 10)))
    # A time without a zone means UTC, whatever the session's zone.
    stamp = r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?)(Z|[+-]\d\d:?\d\d)?"
    zone = F.regexp_extract(c, stamp, 2)
    time = F.try_to_timestamp(F.concat(F.regexp_extract(c, stamp, 1), F.when(zone == "", "Z").otherwise(zone)))
    rest = F.regexp_replace(c, r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?", "")
    numbers = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), lambda n: pad(F.regexp_replace(n, r"^0+(?=\d)", ""))), "")
    order = (
        F.when(c.rlike(r"^[0-9A-Fa-f]{1,16}/[0-9A-Fa-f]{1,16}$"), lsn)
        .when(c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d") & time.isNotNull(), F.concat(pad(F.unix_micros(time).cast("string")), numbers(rest)))
        .when(c.rlike(r"^[0-9A-Fa-f]+(-[0-9A-Fa-f]+)+:\d+$"), numbers(F.substring_index(c, ":", -1)))
        .otherwise(numbers(c))
    )
    return F.when(order != "", order)


def _coarse(order: Column) -> Column:
    """A number that never falls as the order rises, fine enough to cut the feed into batches."""
    second = F.coalesce(F.substring(order, 21, 20).try_cast("double"), F.lit(0.0))
    return F.substring(order, 1, 20).cast("double") * F.lit(1e12) + F.least(second, F.lit(999_999_999_999.0))


def _row_id(image: Column, id_field: str) -> Column:
    hit = F.filter(image, lambda x: x["field_name"] == id_field)
    return F.try_element_at(hit, F.lit(1))["field_value"].try_cast("bigint")


def _as_map(image: Column) -> Column:
    """Fields of an image as a map; of a repeated field the last value counts, unnamed fields are left out."""
    names = F.array_distinct(F.filter(F.transform(image, lambda x: x["field_name"]), lambda n: n.isNotNull()))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.try_element_at(F.filter(image, lambda x: x["field_name"] == n), F.lit(-1))["field_value"]))


def touches(events: DataFrame, id_field: str = "id") -> tuple[DataFrame, DataFrame]:
    """(touches of rows, truncations) of change events.

    Events without a readable checkpoint, source, table, operation or id are repeats or cannot be placed
    and give none. ``op`` counts in any letter case. An update whose images differ in id removes the old
    row and writes the new one; images may be partial.
    """
    op = F.lower(F.trim("op"))
    e = events.select(
        F.col("meta.source").alias("source"), F.col("meta.checkpoint").alias("checkpoint_token"), F.col("table_ref.name").alias("table_name"),
        op.alias("op"), commit_order(F.col("meta.checkpoint")).alias("ord"),
        _row_id(F.col("before"), id_field).alias("old_id"), _row_id(F.col("after"), id_field).alias("new_id"), "before", "after",
    ).filter("ord is not null and source is not null and table_name is not null")
    cut = e.filter("op = 'truncate'").groupBy("source", "table_name").agg(F.max("ord").alias("cut_at"))
    write = F.struct(F.col("new_id").alias("row_id"), F.lit(True).alias("writes"), F.col("after").alias("image"))
    none = F.lit(None).cast(e.schema["after"].dataType)
    drop_old = F.struct(F.col("old_id").alias("row_id"), F.lit(False).alias("writes"), none.alias("image"))
    gone = F.struct(F.coalesce("old_id", "new_id").alias("row_id"), F.lit(False).alias("writes"), none.alias("image"))
    kept = F.struct(F.coalesce("new_id", "old_id").alias("row_id"), F.lit(True).alias("writes"), F.coalesce("after", "before").alias("image"))
    made = (
        F.when(F.col("op") == "insert", F.array(write))
        .when(F.col("op") == "delete", F.array(gone))
        .when((F.col("op") == "update") & (F.col("old_id") != F.col("new_id")), F.array(drop_old, write))
        .when(F.col("op") == "update", F.array(kept))
    )
    rows = e.select("source", "table_name", "ord", "checkpoint_token", F.inline(made)).filter("row_id is not null")
    return rows, cut


def apply_changes(events: DataFrame, base: DataFrame | None = None, *, batches: int = 4, id_field: str = "id", images: bool = True) -> DataFrame:
    """Current rows of every table: source, table_name, row_id, checkpoint_token, ``ord`` and, with
    ``images``, the newest image as a map of field to value.

    ``base`` (source, table_name, row_id, checkpoint_token and, with images, image) are rows from before the feed.
    Repeated events and repeats without a checkpoint change nothing. Events are batched by commit order,
    equally many a source by approximate quantiles, so batches can be resolved newest first wherever the events
    arrived. Truncation removes what its source's table held before it. One key with very many changes is
    reduced map-side. A partial image holds the fields of the last change only. Empty input gives the base.
    """
    rows, cut = touches(events, id_field)
    carried = ["ord", "writes", "checkpoint_token", *(["image"] if images else [])]
    rows = rows.select(*KEY, *carried)
    # Nothing at or before the last truncation of its table can matter.
    rows = rows.join(cut, ["source", "table_name"], "left").filter("cut_at is null or ord > cut_at").drop("cut_at")
    rows = rows.withColumn("coarse", _coarse(F.col("ord")))
    if batches > 1:
        steps = [i / batches for i in range(1, batches)]
        bounds = rows.groupBy("source").agg(F.percentile_approx("coarse", F.array(*[F.lit(s) for s in steps]), F.lit(1000)).alias("bounds"))
        rows = rows.join(bounds, "source", "left").withColumn("batch", F.size(F.filter("bounds", lambda b: b < F.col("coarse")))).drop("bounds")
    else:
        rows = rows.withColumn("batch", F.lit(0))
    newest = F.max_by(F.struct(*carried), F.struct("ord", "writes")).alias("t")
    # One row a key and batch: what is moved from here on is bounded by keys, not by changes.
    firsts = stage(rows.groupBy(*KEY, "batch").agg(newest))
    resolved: DataFrame | None = None
    for b in reversed(range(batches)):
        seen = firsts.filter(F.col("batch") == b).select(*KEY, "t.*")
        if resolved is not None:
            seen = seen.join(resolved.select(*KEY), KEY, "left_anti").unionByName(resolved)
        resolved = stage(seen) if b and batches > 2 else seen
    alive = resolved.filter("writes").drop("writes")
    if images:
        alive = alive.withColumn("image", _as_map(F.col("image")))
    if base is not None:
        untouched = base.join(cut.select("source", "table_name"), ["source", "table_name"], "left_anti").join(resolved.select(*KEY), KEY, "left_anti")
        alive = alive.unionByName(untouched.withColumn("ord", F.lit(None).cast("string")), allowMissingColumns=True)
    return alive
