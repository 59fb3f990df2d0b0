"""Ingestion of CSV, JSON, Parquet, workbooks and database queries into typed datasets.

Files are read lazily by Spark with column pruning; every cell is converted by explicit rules. ``strict`` conversion
raises a ParseError for the first bad cell, ``lossy`` makes it null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.errors import EngineError, IngestIOError, ParseError, SchemaMismatch, translated
from strataline.operators.dataset import ROW, Dataset, with_ordinal
from strataline.sources.bad_rows import FALSE_WORDS, TRUE_WORDS
from strataline.sources.observers import CallbackObserver, IngestContext, IngestSeverity, Observer, severity_of
from strataline.sources.workbook import Workbook, infer_type, select_sheets
from strataline.types import DataType, Field, Schema, canonical, col, logical, quote, schema_of

# Formats by file extension, and names of formats.
EXTENSIONS = {
    "csv": "csv", "json": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet",
    "xlsx": "excel", "xls": "excel", "xlsm": "excel", "xlsb": "excel", "ods": "excel",
}
FORMATS = {"csv": "csv", "json": "json", "ndjson": "json", "parquet": "parquet", "pq": "parquet", "excel": "excel", "xlsx": "excel", "xls": "excel", "ods": "excel"}


@dataclass(frozen=True)
class IngestOptions:
    """``format`` overrides the extension; ``sheets`` chooses sheets of a workbook; ``mode`` is strict or lossy;
    failures at or above ``alert_at_or_above`` also alert the observer. ``multi_line``: quoted CSV cells may hold line breaks, so a
    file is read by one task; without it large files are split."""

    format: str | None = None
    sheets: str | list[str] | None = None
    observer: Observer | None = None
    alert_at_or_above: IngestSeverity = IngestSeverity.CRITICAL
    mode: str = "strict"
    multi_line: bool = True

    @classmethod
    def of(cls, spec: "IngestOptions | dict | None") -> "IngestOptions":
        if spec is None or isinstance(spec, IngestOptions):
            return spec or cls()
        observer = spec.get("observer")
        sheets = spec.get("sheets", spec.get("excel_sheet_selection"))
        if isinstance(sheets, dict):
            sheets = {"first": None, "all": "all"}.get(sheets["mode"], sheets.get("name", sheets.get("names")))
        return cls(
            spec.get("format"), sheets, CallbackObserver(observer) if isinstance(observer, dict) else observer,
            IngestSeverity.parse(spec.get("alert_at_or_above", "critical")), spec.get("mode", "strict"), bool(spec.get("multi_line", True)),
        )

    def with_(self, **changes: Any) -> "IngestOptions":
        return replace(self, **changes)


def detect_format(path: str, override: str | None = None) -> str:
    if override:
        found = FORMATS.get(override.lower())
        if found is None:
            raise ValueError(f"unknown format '{override}'; expected csv, json, parquet, or excel")
        return found
    extension = PurePosixPath(str(path)).suffix.lower().lstrip(".")
    if extension not in EXTENSIONS:
        raise SchemaMismatch(f"cannot tell the format of '{path}' by its extension")
    return EXTENSIONS[extension]


# Conversion of text cells


def parsed(text: Column, kind: DataType) -> Column:
    """A trimmed text cell as its type; null where it cannot be read. Empty cells are null."""
    t = F.trim(F.regexp_replace(text, r"^[\s﻿]+|[\s﻿]+$", ""))
    t = F.when(t != "", t)
    if kind is DataType.UTF8:
        return t
    if kind is DataType.INT64:
        return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    if kind is DataType.FLOAT64:
        return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:nan|inf|infinity)$"), t.try_cast("double"))
    low = F.lower(t)
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def _check_cells(raw: DataFrame, schema: Schema, source: dict[str, Column], first_row: int) -> None:
    """Raise for the first cell in row order that is there but cannot be read."""
    bad = {f.name: source[f.name].isNotNull() & (F.trim(source[f.name]) != "") & parsed(source[f.name], f.data_type).isNull() for f in schema.fields if f.data_type is not DataType.UTF8}
    if not bad:
        return
    anything = F.lit(False)
    for b in bad.values():
        anything = anything | F.coalesce(b, F.lit(False))
    if raw.filter(anything).limit(1).count() == 0:
        return
    which = F.coalesce(*[F.when(b, F.struct(F.lit(n).alias("name"), source[n].alias("cell"))) for n, b in bad.items()])
    r = with_ordinal(raw).filter(anything).orderBy(ROW).select(ROW, which.alias("w")).first()
    kind = schema.type_of(r["w"]["name"])
    raise ParseError(r[ROW] + first_row, r["w"]["name"], r["w"]["cell"], f"not a {kind.title}")


def _typed(raw: DataFrame, schema: Schema, mode: str, first_row: int = 2) -> DataFrame:
    source = {f.name: col(f.name) for f in schema.fields}
    if mode == "strict":
        _check_cells(raw, schema, source, first_row)
    return raw.select(*[parsed(source[f.name], f.data_type).alias(f.name) for f in schema.fields])


def _present(have: Sequence[str], schema: Schema) -> None:
    missing = [n for n in schema.names if n not in have]
    if missing:
        raise SchemaMismatch(f"missing column(s) {', '.join(repr(m) for m in missing)}; have {list(have)}")


# Formats


def _csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', enforceSchema=False)
    return df.select(*[col(c).alias(c.strip().lstrip("﻿")) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: Schema, options: IngestOptions) -> DataFrame:
    """A header is required; columns are found by name, others are ignored. Row numbers of errors count the header as 1."""
    with translated(path):
        raw = _csv_text(spark, path, options.multi_line)
        _present(raw.columns, schema)
        return _typed(raw.select(*[col(n) for n in schema.names]), schema, options.mode)


def read_csv_text(spark: SparkSession, text: str, schema: Schema, options: IngestOptions | None = None) -> DataFrame:
    """CSV held in memory, by the same rules."""
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    header = [h.strip().lstrip("﻿") for h in rows[0]] if rows else []
    _present(header, schema)
    at = [header.index(n) for n in schema.names]
    cells = [tuple(r[i] if i < len(r) else None for i in at) for r in rows[1:]]
    raw = spark.createDataFrame(cells, T.StructType([T.StructField(n, T.StringType()) for n in schema.names]))
    return _typed(raw, schema, (options or IngestOptions()).mode)


def json_path(df: DataFrame, name: str) -> Column | None:
    """The column of a dotted path: a field of that literal name, or nested objects; None if there is no such path."""
    if name in df.columns:
        return col(name)
    t: T.DataType = df.schema
    c: Column | None = None
    for part in name.split("."):
        if not isinstance(t, T.StructType) or part not in t.fieldNames():
            return None
        c = col(part) if c is None else c.getField(part)
        t = t[part].dataType
    return c


def read_json(spark: SparkSession, path: str, schema: Schema, options: IngestOptions) -> DataFrame:
    """An array of objects, or one object a line if the extension is ndjson. Dotted names address nested objects."""
    with translated(path):
        df = spark.read.json(path, multiLine=not path.lower().endswith(".ndjson"), primitivesAsString=True)
        found = {n: json_path(df, n) for n in schema.names}
        missing = [n for n, c in found.items() if c is None]
        if missing:
            raise SchemaMismatch(f"missing column(s) {', '.join(repr(m) for m in missing)}; have {df.columns}")
        raw = df.select(*[c.cast("string").alias(n) for n, c in found.items()])
        return _typed(raw, schema, options.mode, 1)


def read_json_text(spark: SparkSession, text: str, schema: Schema) -> DataFrame:
    """JSON held in memory: an object, an array, or one object a line; strict about types and missing keys."""
    if not text.strip():
        raise EngineError("empty JSON input")
    try:
        data = json.loads(text)
        records = data if isinstance(data, list) else [data]
    except ValueError:
        try:
            records = [json.loads(line) for line in text.splitlines() if line.strip()]
        except ValueError as e:
            raise EngineError(f"invalid JSON: {e}") from e
    rows = []
    for i, r in enumerate(records, 1):
        row = []
        for f in schema.fields:
            value: Any = r
            if isinstance(r, dict) and f.name in r:
                value = r[f.name]
            else:
                for part in f.name.split("."):
                    if value is None:
                        break
                    if not isinstance(value, dict) or part not in value:
                        raise SchemaMismatch(f"row {i}: missing key '{f.name}'")
                    value = value[part]
            row.append(_json_cell(i, f, value))
        rows.append(tuple(row))
    return spark.createDataFrame(rows, schema.to_struct())


def _json_cell(row: int, f: Field, value: Any) -> Any:
    if value is None:
        return None
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if f.data_type is DataType.INT64 and number and float(value).is_integer() and isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ParseError(row, f.name, str(value), "out of the range of Int64")
        return value
    if f.data_type is DataType.FLOAT64 and number:
        return float(value)
    if f.data_type is DataType.BOOL and isinstance(value, bool):
        return value
    if f.data_type is DataType.UTF8 and isinstance(value, str):
        return value
    raise ParseError(row, f.name, json.dumps(value), f"not a {f.data_type.title}")


def read_parquet(spark: SparkSession, path: str, schema: Schema, options: IngestOptions) -> DataFrame:
    """All fields must be there with a fitting type: integers may be read as floats, other types only as themselves."""
    with translated(path):
        df = spark.read.parquet(path)
        _present(df.columns, schema)
        for f in schema.fields:
            have = logical(df.schema[f.name].dataType)
            if have is not f.data_type and not (have is DataType.INT64 and f.data_type is DataType.FLOAT64):
                raise SchemaMismatch(f"column '{f.name}' is {df.schema[f.name].dataType.simpleString()}, wanted {f.data_type.title}")
        return df.select(*[col(f.name).cast(f.data_type.spark).alias(f.name) for f in schema.fields])


def _excel_cell(row: int, f: Field, value: Any, mode: str) -> Any:
    if value is None or value == "":
        return None
    out: Any = None
    if f.data_type is DataType.UTF8:
        out = str(int(value)) if isinstance(value, float) and value.is_integer() else str(value).lower() if isinstance(value, bool) else str(value)
    elif f.data_type is DataType.BOOL:
        word = str(value).strip().lower() if not isinstance(value, float) else str(int(value)) if value in (0.0, 1.0) else ""
        out = value if isinstance(value, bool) else True if word in TRUE_WORDS else False if word in FALSE_WORDS else None
    elif not isinstance(value, bool):
        try:
            x = value if isinstance(value, int) else float(value)
            out = float(x) if f.data_type is DataType.FLOAT64 else int(x) if isinstance(x, int) or x.is_integer() else None
        except ValueError:
            out = None
    if out is None and mode == "strict":
        raise ParseError(row, f.name, str(value), f"not a {f.data_type.title}")
    return out


def read_excel(spark: SparkSession, path: str, schema: Schema, options: IngestOptions) -> DataFrame:
    """Sheets of a workbook, one after the other; the header is the first non-empty row of each."""
    book = Workbook(path)
    rows = []
    for sheet in select_sheets(book, options.sheets):
        header, data = book.table(sheet)
        try:
            _present(header, schema)
            at = [header.index(n) for n in schema.names]
            for i, r in enumerate(data, 2):
                if any(c not in (None, "") for c in r):
                    rows.append(tuple(_excel_cell(i, f, r[k], options.mode) for f, k in zip(schema.fields, at, strict=True)))
        except EngineError as e:
            e.args = (f"sheet '{sheet}': {e}",)
            raise
    return spark.createDataFrame(rows, schema.to_struct())


READERS: dict[str, Callable[..., DataFrame]] = {"csv": read_csv, "json": read_json, "parquet": read_parquet, "excel": read_excel}


def ingest_from_path(spark: SparkSession, path: str, schema, options: IngestOptions | dict | None = None) -> Dataset:
    """Ingest a file. With an observer the result is counted and success or failure reported."""
    o = IngestOptions.of(options)
    context = IngestContext(path, o.format or "?")
    try:
        context = IngestContext(path, detect_format(path, o.format))
        data = Dataset(READERS[context.format](spark, path, Schema.of(schema), o), Schema.of(schema))
        rows = data.row_count() if o.observer else 0
    except (EngineError, OSError, ValueError) as e:
        if o.observer:
            severity = severity_of(e)
            o.observer.on_failure(context, severity, e)
            if severity >= o.alert_at_or_above:
                o.observer.on_alert(context, severity, e)
        raise
    if o.observer:
        o.observer.on_success(context, rows)
    return data


def infer_schema(spark: SparkSession, path: str, options: IngestOptions | dict | None = None) -> Schema:
    """The schema of a file: its own types widened, other types as text. JSON: top-level keys only. Workbooks: the first
    chosen sheet."""
    o = IngestOptions.of(options)
    kind = detect_format(path, o.format)
    with translated(path):
        if kind == "parquet":
            return schema_of(spark.read.parquet(path), strict=False)
        if kind == "json":
            df = spark.read.json(path, multiLine=not path.lower().endswith(".ndjson"))
            return schema_of(df, strict=False)
        if kind == "csv":
            raw = _csv_text(spark, path, o.multi_line)
            # One scan decides all columns: what share of the cells reads as which type.
            fits = [
                F.coalesce(F.min((parsed(col(c), t).isNotNull() | (F.trim(F.coalesce(col(c), F.lit(""))) == "")).cast("int")), F.lit(0)).alias(f"{i}_{t.value}")
                for i, c in enumerate(raw.columns) for t in (DataType.INT64, DataType.FLOAT64)
            ]
            fits += [F.coalesce(F.min((F.lower(F.trim(col(c))).isin("true", "false") | (F.trim(F.coalesce(col(c), F.lit(""))) == "")).cast("int")), F.lit(0)).alias(f"{i}_bool") for i, c in enumerate(raw.columns)]
            fits += [F.count(F.when(F.trim(col(c)) != "", 1)).alias(f"{i}_n") for i, c in enumerate(raw.columns)]
            one = raw.agg(*fits).first()
            pick = lambda i: next((t for t in (DataType.INT64, DataType.FLOAT64, DataType.BOOL) if one[f"{i}_n"] and one[f"{i}_{t.value}"]), DataType.UTF8)
            return Schema(tuple(Field(c, pick(i)) for i, c in enumerate(raw.columns)))
    book = Workbook(path)
    sheet = select_sheets(book, o.sheets)[0]
    header, data = book.table(sheet)
    return Schema(tuple(Field(h, DataType.parse(infer_type(r[i] for r in data))) for i, h in enumerate(header) if h))


def ingest_from_path_infer(spark: SparkSession, path: str, options: IngestOptions | dict | None = None) -> Dataset:
    return ingest_from_path(spark, path, infer_schema(spark, path, options), options)


def ingest_with_inferred_schema(spark: SparkSession, path: str, options: IngestOptions | dict | None = None) -> tuple[Dataset, Schema]:
    schema = infer_schema(spark, path, options)
    return ingest_from_path(spark, path, schema, options), schema


@dataclass(frozen=True)
class IngestRequest:
    path: str
    schema: Any
    options: IngestOptions | dict | None = None

    def run(self, spark: SparkSession) -> Dataset:
        return ingest_from_path(spark, self.path, self.schema, self.options)


# Databases

# URL schemes of databases, their JDBC form and driver class.
DATABASES = {
    "postgres": ("postgresql", "org.postgresql.Driver"), "postgresql": ("postgresql", "org.postgresql.Driver"),
    "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "mssql": ("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"), "sqlserver": ("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": ("oracle:thin", "oracle.jdbc.OracleDriver"),
}


def jdbc_options(connection: str) -> dict[str, str]:
    """JDBC options of a ``scheme://user:password@host:port/database`` URL; JDBC URLs pass through."""
    from urllib.parse import unquote, urlsplit

    if connection.startswith("jdbc:"):
        return {"url": connection}
    u = urlsplit(connection)
    if u.scheme not in DATABASES:
        raise SchemaMismatch(f"unknown database '{u.scheme}'")
    name, driver = DATABASES[u.scheme]
    where = f"{u.hostname or 'localhost'}{f':{u.port}' if u.port else ''}"
    base = u.path.lstrip("/")
    url = f"jdbc:sqlserver://{where};databaseName={base}" if name == "sqlserver" else f"jdbc:oracle:thin:@//{where}/{base}" if u.scheme == "oracle" else f"jdbc:{name}://{where}/{base}"
    out = {"url": url, "driver": driver}
    if u.username:
        out["user"] = unquote(u.username)
    if u.password:
        out["password"] = unquote(u.password)
    return out


def _query(spark: SparkSession, connection: str, sql: str, partition: dict[str, str] | None) -> DataFrame:
    options = jdbc_options(connection)
    driver = options.get("driver")
    if driver:
        try:
            spark._jvm.java.lang.Class.forName(driver, False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        except Exception as e:
            raise SchemaMismatch(f"database support needs the driver {driver} on the class path") from e
    reader = spark.read.format("jdbc").options(**options, **(partition or {}))
    with translated("database"):
        return (reader.option("dbtable", f"({sql}) q") if partition else reader.option("query", sql)).load()


def ingest_from_db(spark: SparkSession, connection: str, sql: str, schema, partition: dict[str, str] | None = None) -> Dataset:
    """A read-only query. ``partition`` (partitionColumn, lowerBound, upperBound, numPartitions) reads in parallel."""
    schema = Schema.of(schema)
    df = _query(spark, connection, sql, partition)
    _present(df.columns, schema)
    return Dataset(df.select(*[col(f.name).try_cast(f.data_type.spark).alias(f.name) for f in schema.fields]), schema)


def ingest_from_db_infer(spark: SparkSession, connection: str, sql: str, partition: dict[str, str] | None = None) -> Dataset:
    """The same with the query's own types; others become text."""
    df = _query(spark, connection, sql, partition)
    schema = schema_of(df, strict=False)
    return Dataset(canonical(df.select(*[col(f.name).cast(f.data_type.spark).alias(f.name) for f in schema.fields])), schema)


__all__ = [
    "IngestIOError", "IngestOptions", "IngestRequest", "detect_format", "infer_schema", "ingest_from_db", "ingest_from_db_infer",
    "ingest_from_path", "ingest_from_path_infer", "ingest_with_inferred_schema", "quote",
]
