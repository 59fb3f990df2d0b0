"""Flat function names over the operators, for scripts."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import SparkSession

from strataline.cdc import CdcCheckpoint, CdcEvent, CdcOp, RowImage, SourceMeta, TableRef
from strataline.execution import ExecutionEngine
from strataline.operators.dataset import Dataset
from strataline.operators.frame import Frame
from strataline.plans.sql_context import SqlContext, query
from strataline.plans.transform import TransformSpec
from strataline.quality.outliers import detect
from strataline.quality.profile import profile
from strataline.quality.validate import validate
from strataline.sources.readers import (
    infer_schema,
    ingest_from_db,
    ingest_from_db_infer,
    ingest_from_path,
    ingest_from_path_infer,
    ingest_with_inferred_schema,
)

DataFrame, DataSet = Frame, Dataset
infer_schema_from_path = infer_schema


def extension_version() -> str:
    from strataline import __version__

    return __version__


def make_dataset(spark: SparkSession, schema, rows) -> Dataset:
    return Dataset.from_rows(spark, schema, rows)


def processing_filter(data: Dataset, keep: Callable[[list[Any]], bool]) -> Dataset:
    return data.filter(keep)


def processing_map(data: Dataset, fn: Callable[[list[Any]], list[Any]]) -> Dataset:
    return data.map(fn)


def processing_reduce(data: Dataset, column: str, op: str) -> Any:
    return data.reduce(column, op)


def processing_feature_wise_mean_std(data: Dataset, columns: Sequence[str], std_kind: str | None = None) -> dict:
    return data.feature_wise_mean_std(columns, std_kind)


def processing_arg_max_row(data: Dataset, column: str):
    return data.arg_max_row(column)


def processing_arg_min_row(data: Dataset, column: str):
    return data.arg_min_row(column)


def processing_top_k_by_frequency(data: Dataset, column: str, k: int):
    return data.top_k_by_frequency(column, k)


def sql_query_dataset(data: Dataset, sql: str) -> Dataset:
    return query(data.frame(), sql).collect()


def transform_apply(data: Dataset, spec: TransformSpec | dict) -> Dataset:
    return (spec if isinstance(spec, TransformSpec) else TransformSpec.from_json(spec)).apply(data)


def transform_apply_json(data: Dataset, spec: str) -> Dataset:
    return TransformSpec.from_json(spec).apply(data)


def profile_dataset_json(data: Dataset, options: dict | None = None) -> str:
    return profile(data, options).to_json()


def profile_dataset_markdown(data: Dataset, options: dict | None = None) -> str:
    return profile(data, options).to_markdown()


def profile_dataset(data: Dataset, options: dict | None = None) -> dict:
    return json.loads(profile_dataset_json(data, options))


def validate_dataset_json(data: Dataset, spec: dict) -> str:
    return validate(data, spec).to_json()


def validate_dataset_markdown(data: Dataset, spec: dict) -> str:
    return validate(data, spec).to_markdown()


def validate_dataset(data: Dataset, spec: dict) -> dict:
    return json.loads(validate_dataset_json(data, spec))


def _head(options: dict | None) -> dict:
    o = options or {}
    sampling = o.get("sampling")
    head = sampling.get("head") if isinstance(sampling, dict) else o.get("head_rows")
    return {"head": head, "max_examples": o.get("max_examples", 5)}


def detect_outliers_json(data: Dataset, column: str, method: dict | str, options: dict | None = None) -> str:
    return detect(data, column, method, **_head(options)).to_json()


def detect_outliers_markdown(data: Dataset, column: str, method: dict | str, options: dict | None = None) -> str:
    return detect(data, column, method, **_head(options)).to_markdown()


def detect_outliers(data: Dataset, column: str, method: dict | str, options: dict | None = None) -> dict:
    return json.loads(detect_outliers_json(data, column, method, options))


__all__ = [
    "CdcCheckpoint", "CdcEvent", "CdcOp", "DataFrame", "DataSet", "ExecutionEngine", "RowImage", "SourceMeta", "SqlContext", "TableRef",
    "detect_outliers", "detect_outliers_json", "detect_outliers_markdown", "extension_version", "infer_schema_from_path",
    "ingest_from_db", "ingest_from_db_infer", "ingest_from_path", "ingest_from_path_infer", "ingest_with_inferred_schema", "make_dataset",
    "processing_arg_max_row", "processing_arg_min_row", "processing_feature_wise_mean_std", "processing_filter", "processing_map",
    "processing_reduce", "processing_top_k_by_frequency", "profile_dataset", "profile_dataset_json", "profile_dataset_markdown",
    "sql_query_dataset", "transform_apply", "transform_apply_json", "validate_dataset", "validate_dataset_json", "validate_dataset_markdown",
]
