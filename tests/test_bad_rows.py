import pyarrow as pa
import pytest

from strataline.sources.bad_rows import parse_lines, parse_rows, split_rows

HEADER = "id,name,score,active"


def one(line, header=HEADER):
    got = parse_lines(pa.array([line], pa.string()), header)
    return got["reason"][0], tuple(got[f][0].as_py() for f in ("id", "name", "score", "active"))


@pytest.mark.parametrize(("line", "want"), [
    (" 5 ,Ada, 9.5 ,YES", (5, "Ada", 9.5, True)), ('"7" ,"a, ""b""\nc",.5,n', (7, 'a, "b"\nc', 0.5, False)), (",,,", (None, None, None, None)), ('1,"",1e3,F\r', (1, None, 1000.0, False)),
    ("+12,x,-3.,0", (12, "x", -3.0, False)), ("9223372036854775807,x,,", (2**63 - 1, "x", None, None)), ("-9223372036854775808,x,,", (-(2**63), "x", None, None)), ("0000000000000000000005,x,,", (5, "x", None, None)),
])
def test_valid(line, want):
    assert one(line) == (None, want)


@pytest.mark.parametrize(("line", "reason"), [
    ('1,"Ada,9.5,t', "quoting"), ('1,A"da,9.5,t', "quoting"), ('1,"Ada"x,9.5,t', "quoting"), ('1,"Ada""",9.5"', "quoting"), ("1,Ada,9.5", "column_count"), ("1,Ada,9.5,t,", "column_count"),
    ("1;Ada;9.5;t", "column_count"), ("x,Ada,high,t", "bad_id"), ("1.0,Ada,1,t", "bad_id"), ("９,Ada,1,t", "bad_id"), ("9223372036854775808,x,,", "bad_id"), ("1 2,x,,", "bad_id"),
    ("1,Ada,high,maybe", "bad_score"), ("1,Ada,1e,t", "bad_score"), ("1,Ada,.,t", "bad_score"), ("1,Ada,nan,t", "bad_score"), ("1,Ada,1,2", "bad_active"), (" \t\r", "blank"), (None, "blank"),
])
def test_reasons(line, reason):
    assert one(line)[0] == reason


def test_header_layouts():
    assert one("yes,note,3,Ada,1", "﻿active,note,id,name,score\r")[1] == (3, "Ada", 1.0, True)
    assert one("1,Ada", "id,name") == (None, (1, "Ada", None, None))
    assert one("1,Ada,2,t", None)[0] is None


def test_very_long_lines():
    text = "x" * 3_000_000
    assert one(f"1,{text},2,t") == (None, (1, text, 2.0, True)) and one(f'1,"{text},2,t')[0] == "quoting"


def test_files(spark):
    rows = [(1, 1, HEADER), (1, 2, "1,a,1,t"), (1, 3, ""), (1, 4, "x,a,1,t"), (2, 1, "name,id,active,score"), (2, 2, "b,2,f,3"), (2, 2, "b,2,f,3"), (3, 5, "3,c,,"), (3, 6, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "file_no int, line_no int, raw_line string, id int")
    valid, rejected = split_rows(df)
    assert sorted(map(tuple, valid.collect())) == [(1, 2, 1, "a", 1.0, True), (2, 2, 2, "b", 3.0, False), (2, 2, 2, "b", 3.0, False), (3, 5, 3, "c", None, None)]
    assert [tuple(r) for r in rejected.collect()] == [(1, 4, "bad_id", "x", "x,a,1,t")]
    assert parse_rows(df.limit(0)).count() == 0


def test_hot_file_and_null_numbers(spark):
    rows = [(1, 1, "active,id,name,score")] + [(1, i, f"t,{i},n,1" if i % 50 else f"t,x{i},n,1") for i in range(2, 1000)] + [(None, 7, "1,a,2,t"), (5, None, "2,b,3,f")]
    valid, rejected = split_rows(spark.createDataFrame(rows, "file_no int, line_no int, raw_line string"))
    assert rejected.count() == 19 and valid.count() == 998 - 19 + 2
