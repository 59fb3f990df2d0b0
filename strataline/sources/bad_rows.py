"""Delimited text with rows that fail (problem 6): valid rows typed, failing rows with their reason.

Structure is judged by the CSV reader of pyarrow with an invalid-row callback, per Arrow batch and
header layout; all fields are read as strings, whole vectors are trimmed and cast, and cells that fail to
cast are labelled. Quoting errors, which that reader lets pass, are found before by one linear-time
regular expression per line.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.common import salted_lookup, stage

# Spellings of booleans, in any letter case.
TRUE_WORDS = ["true", "t", "1", "yes", "y"]
FALSE_WORDS = ["false", "f", "0", "no", "n"]

FIELDS = ["id", "name", "score", "active"]
#: White space and invisible characters that may surround lines and cells.
EDGE = " \t\r\n\v\f\u0085             ​‌‍    ⁠　﻿"
_PAD = "[" + EDGE.replace("\n", r"\n").replace("\r", r"\r") + "]*"
_CELL = f'(?:{_PAD}"(?:[^"]|"")*"{_PAD}|[^",]*)'
WELL_QUOTED = rf"\A{_CELL}(?:,{_CELL})*\z"
_PADDED_QUOTE = f'(\\A|,){_PAD}("(?:[^"]|"")*"){_PAD}'

OUT = pa.schema([
    ("file_no", pa.int32()), ("line_no", pa.int32()), ("id", pa.int64()), ("name", pa.string()), ("score", pa.float64()),
    ("active", pa.bool_()), ("reason", pa.string()), ("cell", pa.string()), ("raw_line", pa.string()),
])


def split_header(header: str | None) -> list[str]:
    """Column names of a header line, without invisible characters, in lower case; a missing header means
    the usual order."""
    text = (header or "").strip(EDGE)
    if not text:
        return list(FIELDS)
    return [c.strip(EDGE).lower() for c in next(csv.reader(io.StringIO(text)))]


def _int64(text: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(values, failed) of trimmed cells; null stays null."""
    shape = pc.match_substring_regex(text, r"^[+-]?[0-9]+$")
    negative = pc.starts_with(text, "-")
    digits = pc.replace_substring_regex(text, r"^[+-]?0*([0-9])", r"\1")
    size = pc.utf8_length(digits)
    most = pc.if_else(negative, "9223372036854775808", "9223372036854775807")
    fits = pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(digits, most)))
    good = pc.and_(shape, fits)
    clean = pc.if_else(good, pc.if_else(negative, pc.binary_join_element_wise("-", digits, ""), digits), None)
    return clean.cast(pa.int64()), pc.fill_null(pc.invert(good), False).to_numpy(zero_copy_only=False)


def _float(text: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    good = pc.match_substring_regex(text, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    plain = pc.replace_substring_regex(pc.if_else(good, text, None), r"^\+", "")
    return plain.cast(pa.float64()), pc.fill_null(pc.invert(good), False).to_numpy(zero_copy_only=False)


def _bool(text: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    low = pc.utf8_lower(text)
    yes, no = pc.is_in(low, pa.array(TRUE_WORDS)), pc.is_in(low, pa.array(FALSE_WORDS))
    known = pc.or_(yes, no)
    null = pc.is_null(text)
    return pc.if_else(known, yes, None), pc.and_(pc.invert(known), pc.invert(null)).to_numpy(zero_copy_only=False)


def parse_lines(lines: pa.Array, header: str | None) -> dict[str, list | pa.Array | np.ndarray]:
    """Parse lines of one header layout. Gives arrays as long as ``lines``: the four fields, ``reason``
    (null for valid rows, ``blank`` for rows that are no records) and ``cell``, the text that failed."""
    names = split_header(header)
    n = len(lines)
    reason, cell = np.full(n, None, object), np.full(n, None, object)
    text = pc.utf8_trim(pc.fill_null(lines, ""), EDGE)
    blank = pc.equal(text, "").to_numpy(zero_copy_only=False)
    quoted = pc.match_substring_regex(text, WELL_QUOTED).to_numpy(zero_copy_only=False)
    reason[blank], reason[~blank & ~quoted] = "blank", "quoting"
    at = np.flatnonzero(~blank & quoted)
    out: dict = {"id": pa.nulls(n, pa.int64()), "name": pa.nulls(n, pa.string()), "score": pa.nulls(n, pa.float64()), "active": pa.nulls(n, pa.bool_())}
    if len(at):
        tidy = pc.replace_substring_regex(text.take(pa.array(at)), _PADDED_QUOTE, r"\1\2")
        data = "".join(f"{i},{line}\n" for i, line in zip(at.tolist(), tidy.to_pylist(), strict=True)).encode()
        rejected: list[int] = []

        def invalid(row: pacsv.InvalidRow) -> str:
            rejected.append(int(row.text[: row.text.index(",")]))
            return "skip"

        columns = ["at", *[f"c{i}" for i in range(len(names))]]
        read = pacsv.read_csv(
            pa.BufferReader(data),
            read_options=pacsv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=columns),
            parse_options=pacsv.ParseOptions(newlines_in_values=True, double_quote=True, ignore_empty_lines=False, invalid_row_handler=invalid),
            convert_options=pacsv.ConvertOptions(column_types={"at": pa.int64()} | {c: pa.string() for c in columns[1:]}, strings_can_be_null=False),
        )
        reason[rejected] = "column_count"
        rows = read["at"].to_numpy()
        where = np.full(n, -1)
        where[rows] = np.arange(len(rows))
        pick = pa.array(where, mask=where < 0)
        for field, cast, label in (("id", _int64, "bad_id"), ("name", None, ""), ("score", _float, "bad_score"), ("active", _bool, "bad_active")):
            if field not in names:
                continue
            trimmed = pc.utf8_trim(read[f"c{names.index(field)}"].combine_chunks(), EDGE)
            trimmed = pc.if_else(pc.equal(trimmed, ""), None, trimmed)
            if cast is None:
                out[field] = trimmed.take(pick)
                continue
            values, failed = cast(trimmed)
            out[field] = values.take(pick)
            bad = rows[failed]
            first = bad[reason[bad] == None]  # noqa: E711
            texts = trimmed.to_numpy(zero_copy_only=False)[where[first]] if len(first) else []
            reason[first], cell[first] = label, texts
    return out | {"reason": reason, "cell": cell}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        headers = batch["header"].to_pylist()
        by: dict = {}
        for i, h in enumerate(headers):
            by.setdefault(h, []).append(i)
        for header, at in by.items():
            part = batch.take(pa.array(at))
            got = parse_lines(part["raw_line"], header)
            reason = got["reason"]
            keep = np.flatnonzero(reason != "blank")
            table = pa.record_batch(
                [part["file_no"], part["line_no"], got["id"], got["name"], got["score"], got["active"], pa.array(reason, pa.string()), pa.array(got["cell"], pa.string()), part["raw_line"]],
                schema=OUT,
            )
            yield table.take(pa.array(keep))


def parse_rows(raw: DataFrame) -> DataFrame:
    """All records of ``raw`` (file_no, line_no, raw_line) with their fields and ``reason``.

    Line 1 of a file is its header and orders its cells; a file without one is read as
    id,name,score,active; a field that a header lacks is null in all its rows. Headers and blank or null lines are no records. Cells are trimmed; an empty cell
    is null and valid. ``reason`` is null for valid rows, else the first of quoting, column_count, bad_id,
    bad_score, bad_active that applies, and all fields of such a row are to be ignored. Columns beside the
    three are left out. Lines of any length are parsed whole. Rows of a hot file are spread by line.
    """
    lines = raw.select(F.col("file_no").cast("int").alias("file_no"), F.col("line_no").cast("int").alias("line_no"), "raw_line")
    headers = stage(lines.filter("line_no = 1").groupBy("file_no").agg(F.min("raw_line").alias("header")))
    records = salted_lookup(lines.filter("line_no is null or line_no <> 1"), headers, ["file_no"], ["line_no"])
    return records.mapInArrow(_parse, "file_no int, line_no int, id bigint, name string, score double, active boolean, reason string, cell string, raw_line string")


def split_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid people rows, rejected rows with reason, failing cell and the line as it came)."""
    rows = parse_rows(raw)
    valid = rows.filter("reason is null").select("file_no", "line_no", *FIELDS)
    return valid, rows.filter("reason is not null").select("file_no", "line_no", "reason", "cell", "raw_line")
