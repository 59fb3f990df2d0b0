"""The pN_ queries of the general problems, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.common import best_per_key, epoch_micros, stage, table
from strataline.operators.change_feed import apply_changes
from strataline.operators import drift, load_profile, spikes
from strataline.operators.nested import job_run_tables
from strataline.operators.percentiles import combine, percentiles, value_counts
from strataline.sources.bad_rows import split_rows

PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error object of every attempt of every task, each run once."""
    errors = job_run_tables(table(spark, sf_dir, "job_runs_sample")).route("error", columns=["code"])
    return errors.union().select("run_id", "task_key", F.col("attempt_no").cast("int").alias("attempt_no"), "code")


def p1_error_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtype tables of errors: their variant, their columns and how many errors each holds."""
    errors = job_run_tables(table(spark, sf_dir, "job_runs_sample")).route("error")
    each = [(shape, errors.table(shape)) for shape in errors.shapes()]
    counts = [t.agg(F.lit(shape).alias("shape"), F.lit(",".join(t.columns)).alias("columns"), F.count(F.lit(1)).alias("n")) for shape, t in each]
    return reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "shape string, columns string, n bigint")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat run table, each run once."""
    tables = job_run_tables(table(spark, sf_dir, "job_runs_sample"))
    runs = tables.table("run", columns=["job_id", "creator_user_name", "created_time", "team", "env", "num_workers", "duration_ms", "success", "bytes_written"])
    # NaN equals nothing when results are compared, so the query tells it apart in a column of its own.
    state = F.when(F.col("duration_ms").isNull(), "null").when(F.isnan("duration_ms"), "nan").otherwise("number")
    return runs.withColumn("duration_state", state).withColumn("duration_ms", F.when(state == "number", F.col("duration_ms")))


def p1_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat task table with its parent's id."""
    return job_run_tables(table(spark, sf_dir, "job_runs_sample")).table("task", columns=["task_key"])


def p1_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat attempt table with its parents' ids."""
    return job_run_tables(table(spark, sf_dir, "job_runs_sample")).table("attempt", columns=["attempt_no", "duration_ms", "success"])


def p1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects of each structural variant every level holds."""
    tables = job_run_tables(table(spark, sf_dir, "job_runs_sample"))
    parts = [tables.variants(level).withColumn("level", F.lit(level)) for level in tables.levels]
    return reduce(DataFrame.unionByName, parts).select("level", "shape", "n")


def p1_whole_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs have each structural variant, all nested arrays included."""
    return job_run_tables(table(spark, sf_dir, "job_runs_sample")).whole_variants()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a file against the file before it in its feed."""
    lines = table(spark, sf_dir, "job_run_files")
    return drift.changes(lines, stage(drift.profile(lines))).select("feed", "file_no", "change_kind", "field_path", "new_path")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field of each file holds each JSON kind."""
    kinds = drift.profile(table(spark, sf_dir, "job_run_files")).filter("path <> ''")
    return kinds.select("feed", "file_no", "path", F.substring("feature", 3, 20).alias("kind"), "n")


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files as one table, fields under their first names."""
    lines = table(spark, sf_dir, "job_run_files")
    kinds = stage(drift.profile(lines))
    return drift.unify(lines, kinds, stage(drift.changes(lines, kinds)))


def p2_unified_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells that are not null of each file in the one table: nothing of a file is lost in it."""
    out = p2_unified(spark, sf_dir)
    cells = [F.col(f"`{c}`").isNotNull().cast("int") for c in out.columns if c not in ("feed", "file_no", "line_no")]
    held = F.aggregate(F.array(*cells), F.lit(0), lambda a, b: a + b) if cells else F.lit(0)
    return out.groupBy("feed", "file_no").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(held.cast("bigint")).alias("n_cells"))


MEASURES = ["duration_ms", "bytes_written"]


def _day_partials(spark: SparkSession, sf_dir: str, groups: list[str]) -> dict[str, DataFrame]:
    """The stored day-wise partial results of each measure, each run taken once."""
    runs = table(spark, sf_dir, "job_runs_sample").select(
        "run_id", "received_at", "job_id", F.col("settings.tags.team").alias("team"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_time") / 86_400_000).cast("int")).alias("day"),
        F.col("metrics.duration_ms").alias("duration_ms"), F.col("metrics.bytes_written").alias("bytes_written"),
    )
    once = stage(best_per_key(runs, ["run_id"], ["team", "job_id", "day", *MEASURES], [F.col("received_at")]))
    return {m: stage(value_counts(once, groups, "day", m)) for m in MEASURES}


def _percentiles(partials: dict[str, DataFrame], groups: list[str]) -> DataFrame:
    parts = [percentiles(combine(p), groups, PERCENTILES).withColumn("metric", F.lit(m)) for m, p in partials.items()]
    cols = [*groups, "metric", "fraction", F.round("value", 3).alias("value"), "n", "rank_error"]
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])


def p3_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of run time and bytes written per team and job, combined from stored day-wise value counts."""
    return _percentiles(_day_partials(spark, sf_dir, ["team", "job_id"]), ["team", "job_id"])


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of run time and bytes written per team, combined from stored day-wise value counts."""
    return _percentiles(_day_partials(spark, sf_dir, ["team"]), ["team"])


def p3_two_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of each measure's last 14 days: the stored results of these days asked again, two weeks stored apart and combined."""
    out = []
    for m, stored in _day_partials(spark, sf_dir, ["team"]).items():
        last = stored.agg(F.max("part")).first()[0]
        week = lambda k: stored.filter(F.datediff(F.lit(last), "part").between(7 * k, 7 * k + 6))  # noqa: B023, E731
        out.append(_percentiles({m: combine(stage(week(0)), stage(week(1)))}, ["team"]))
    return reduce(DataFrame.unionByName, out)


PEOPLE = ["id", "name", "score", "active", "grp", "badge"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of loads that are out of line with the site's other loads or with their report."""
    values, counts = load_profile.profile(table(spark, sf_dir, "people"), "site", "load_no", PEOPLE)
    told = table(spark, sf_dir, "column_profile").withColumnsRenamed({"site": "source", "load_no": "load"})
    found = load_profile.departures(values, counts, {"score": (0.0, 100.0)}).unionByName(load_profile.reported_wrong(counts, told))
    return found.select(F.col("source").alias("site"), F.col("load").alias("load_no"), "column_name").distinct()


def p4_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every column of every load."""
    _, counts = load_profile.profile(table(spark, sf_dir, "people"), "site", "load_no", PEOPLE)
    return counts.select(
        F.col("source").alias("site"), F.col("load").alias("load_no"), "column_name", "row_count", "null_count", "distinct_count",
        F.round("min_value", 4).alias("min_value"), F.round("max_value", 4).alias("max_value"), F.round("mean_value", 4).alias("mean_value"),
    )


def p4_conformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the induced expressions per load and text column."""
    values, _ = load_profile.profile(table(spark, sf_dir, "people"), "site", "load_no", PEOPLE)
    return load_profile.conformity(values).withColumnsRenamed({"source": "site", "load": "load_no"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose duration is impossible, stuck or a spike of its job."""
    runs = table(spark, sf_dir, "job_runs_sample").select(
        "run_id", "job_id", "created_time", "received_at", F.col("metrics.duration_ms").alias("value"), F.col("metrics.success").alias("ok")
    )
    once = best_per_key(runs, ["run_id"], ["job_id", "created_time", "received_at", "value", "ok"], [F.col("received_at")])
    most = (epoch_micros("received_at") / 1000 - F.col("created_time")).alias("most")
    readings = once.select(F.col("job_id").alias("source"), F.col("run_id").alias("id"), F.col("created_time").alias("at"), "value", "ok", most)
    return spikes.implausible(readings).select(F.col("source").alias("job_id"), F.col("id").alias("run_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail to parse, with the first reason."""
    return split_rows(table(spark, sf_dir, "people_raw"))[1].select("file_no", "line_no", "reason")


def p6_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that parse, typed."""
    return split_rows(table(spark, sf_dir, "people_raw"))[0]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that exist after all events, with the checkpoint of the change that wrote them last."""
    rows = apply_changes(table(spark, sf_dir, "cdc_event"), images=False)
    return rows.select("source", "table_name", "row_id", "checkpoint_token")


def p7_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with their images, and rows from before the feed: those of region, a table that no event touches."""
    base = table(spark, sf_dir, "region").select(
        F.lit("before").alias("source"), F.lit("region").alias("table_name"), F.col("r_regionkey").cast("bigint").alias("row_id"), F.lit("0").alias("checkpoint_token"), F.create_map(F.lit("name"), "r_name").alias("image")
    )
    rows = apply_changes(table(spark, sf_dir, "cdc_event"), base)
    fields = F.array_sort(F.transform(F.map_entries("image"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return rows.select("source", "table_name", "row_id", "checkpoint_token", F.array_join(fields, ";").alias("image"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p1_tasks, p1_attempts, p1_variants, p1_whole_variants, p1_error_subtypes, p2_found, p2_kinds, p2_unified, p2_unified_cells, p3_by_job, p3_percentiles, p3_two_weeks, p4_found, p4_profiles, p4_conformity, p5_found, p6_found, p6_people, p7_found, p7_rows)}
