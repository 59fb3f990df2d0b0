import json
import os
import subprocess
import sys
import zipfile
from importlib.util import find_spec
from pathlib import Path

import pytest

from strataline.errors import EngineError, IngestIOError, ParseError, SchemaMismatch
from strataline.sources.observers import CompositeObserver, FileObserver, IngestSeverity, Observer
from strataline.sources.readers import IngestOptions, IngestRequest, detect_format, infer_schema, ingest_from_db, ingest_from_path, ingest_with_inferred_schema, jdbc_options, read_csv_text, read_json_text
from strataline.types import Schema

PEOPLE = [("id", "int64"), ("name", "utf8"), ("score", "float64"), ("active", "bool")]
WANT = [[1, "Ada", 98.5, True], [2, "Grace", 87.25, False]]


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "p.csv", "﻿name,extra,id,active,score\n Ada ,x,1,YES,98.5\n\"Grace\",y,2,f,87.25\n")
    assert ingest_from_path(spark, path, PEOPLE).to_rows() == WANT
    assert [f["data_type"] for f in infer_schema(spark, path).to_list()] == ["utf8", "utf8", "int64", "utf8", "float64"]
    with pytest.raises(SchemaMismatch, match="schema mismatch"):
        ingest_from_path(spark, path, [("nope", "int64")])


def test_csv_modes(spark, tmp_path):
    path = write(tmp_path / "p.csv", "id,name,score,active\n1,Ada,98.5,t\nx,Bob,,\n")
    with pytest.raises(ParseError) as e:
        ingest_from_path(spark, path, PEOPLE)
    assert (e.value.row, e.value.column, e.value.raw) == (3, "id", "x")
    assert ingest_from_path(spark, path, PEOPLE, {"mode": "lossy"}).to_rows()[1] == [None, "Bob", None, None]
    assert read_csv_text(spark, "id\n 5 \n", Schema.of([("id", "int64")])).collect()[0][0] == 5


def test_json(spark, tmp_path):
    path = write(tmp_path / "p.json", json.dumps([{"id": 1, "user": {"name": "Ada"}, "ok": True}, {"id": 2, "user": None, "ok": None}]))
    schema = [("id", "int64"), ("user.name", "utf8"), ("ok", "bool")]
    assert ingest_from_path(spark, path, schema).to_rows() == [[1, "Ada", True], [2, None, None]]
    lines = write(tmp_path / "p.ndjson", '{"id": 1}\n{"id": 2}\n')
    assert ingest_from_path(spark, lines, [("id", "int64")]).row_count() == 2
    with pytest.raises(SchemaMismatch):
        ingest_from_path(spark, path, [("user.age", "int64")])


def test_json_text(spark):
    schema = Schema.of([("a.b", "int64"), ("s", "utf8")])
    assert read_json_text(spark, '{"a": {"b": 1}, "s": null}', schema).collect()[0][0] == 1
    for text, error in (("", EngineError), ("[{]", EngineError), ('{"s": "x"}', SchemaMismatch), ('{"a": {"b": "1"}, "s": ""}', ParseError), ('{"a": {"b": 18446744073709551615}, "s": ""}', ParseError)):
        with pytest.raises(error):
            read_json_text(spark, text, schema)


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.sql("select cast(1 as int) as id, 'x' as name").write.parquet(path)
    assert ingest_from_path(spark, path, [("id", "float64")]).to_rows() == [[1.0]]
    for schema in ([("name", "int64")], [("nope", "utf8")], [("id", "utf8")]):
        with pytest.raises(SchemaMismatch):
            ingest_from_path(spark, path, schema)
    assert ingest_with_inferred_schema(spark, path)[1].names == ["id", "name"]


def workbook(path, sheets):
    names = list(sheets)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            rows = ""
            for r, cells in enumerate(sheets[n], 1):
                out = ""
                for k, v in enumerate(cells):
                    ref = f"{chr(65 + k)}{r}"
                    if isinstance(v, bool):
                        out += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, int | float):
                        out += f'<c r="{ref}"><v>{v}</v></c>'
                    elif v is not None:
                        out += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                rows += f'<row r="{r}">{out}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


def test_workbooks(spark, tmp_path):
    head = ["id", "name", "score", "active"]
    path = workbook(tmp_path / "w.xlsx", {"One": [[], head, [1, "Ada", 98.5, True], [2, "Grace", 87.25, False]], "Two": [head, [3, "Lin", None, "yes"]]})
    assert ingest_from_path(spark, path, PEOPLE).to_rows() == WANT
    assert ingest_from_path(spark, path, PEOPLE, {"sheets": "all"}).row_count() == 3
    assert ingest_from_path(spark, path, PEOPLE, {"excel_sheet_selection": {"mode": "sheet", "name": "Two"}}).to_rows() == [[3, "Lin", None, True]]
    assert [f["data_type"] for f in infer_schema(spark, path).to_list()] == ["int64", "utf8", "float64", "bool"]
    with pytest.raises(EngineError, match="Two"):
        ingest_from_path(spark, path, [("name", "int64")], {"sheets": ["Two"]})
    with pytest.raises(EngineError):
        ingest_from_path(spark, str(tmp_path / "old.xls"), PEOPLE)


def test_formats():
    assert [detect_format(p) for p in ("a.CSV", "b.pq", "c.ndjson", "d.xlsm")] == ["csv", "parquet", "json", "excel"]
    assert detect_format("x", "csv") == "csv"
    for bad in ("x", "x.txt"):
        with pytest.raises(SchemaMismatch):
            detect_format(bad)


class Recorder(Observer):
    def __init__(self):
        self.seen = []

    def on_success(self, context, rows):
        self.seen.append(("ok", rows))

    def on_failure(self, context, severity, error):
        self.seen.append(("failure", severity))


def test_observers(spark, tmp_path):
    watch, log = Recorder(), tmp_path / "log"
    both = IngestOptions(observer=CompositeObserver([watch, FileObserver(log)]))
    with pytest.raises(IngestIOError):
        ingest_from_path(spark, str(tmp_path / "missing.csv"), PEOPLE, both)
    path = write(tmp_path / "p.csv", "id\n1\n")
    with pytest.raises(SchemaMismatch):
        ingest_from_path(spark, path, PEOPLE, both)
    assert IngestRequest(path, [("id", "int64")], both).run(spark).row_count() == 1
    # The default alert repeats a critical failure.
    assert watch.seen == [("failure", IngestSeverity.CRITICAL)] * 2 + [("failure", IngestSeverity.ERROR), ("ok", 1)]
    assert "ALERT" in log.read_text()


def test_databases(spark):
    assert jdbc_options("postgres://u:p%40@h:5/db") == {"url": "jdbc:postgresql://h:5/db", "driver": "org.postgresql.Driver", "user": "u", "password": "p@"}
    with pytest.raises(SchemaMismatch):
        jdbc_options("sqlite://x")
    with pytest.raises(SchemaMismatch, match="driver"):
        ingest_from_db(spark, "mysql://h/db", "select 1", [("x", "int64")])


CLUSTER = """
import json, sys
import __spark_entry__
from pyspark.sql import SparkSession
folder, name = sys.argv[1:]
conf = {"spark.checkpoint.dir": f"file://{folder}/shared", "spark.executor.memory": "512m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
print(json.dumps([list(r) for r in __spark_entry__.queries()[name](spark, folder).collect()]))
"""


def on_cluster(folder, name):
    """Rows of a query whose executors are processes of their own."""
    home, repo = folder / "home", Path(__file__).resolve().parent.parent
    home.mkdir()
    for p in Path(find_spec("pyspark").origin).parent.iterdir():  # the executors' logs go to Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(repo), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", CLUSTER, str(folder), name], env=env, cwd=folder, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr
    return json.loads(run.stdout.splitlines()[-1])


SUPPLIERS = [
    (1, "plain", 1.5), (2, 'say "x", \\"\r\ny', 2.25), (0, "", 0.1), (None, " é€😀\t", 1e-300), (2**63 - 1, None, 1.7976931348623157e308),
    (1001, "x" * 40000, 5e-324), (-5, "debt", -3.5), (500, "none", None), (501, "zero", 0.0),
]


@pytest.mark.parametrize("rows", [SUPPLIERS, []])
def test_database_of_a_cluster(spark, tmp_path, rows):
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_acctbal double").repartition(3).write.parquet(f"{tmp_path}/supplier.parquet")
    got = on_cluster(tmp_path, "db_ingest")
    assert sorted(map(repr, got)) == sorted(repr(list(r)) for r in rows if (r[2] or 0) > 0)


def test_database_of_a_cluster_read_in_parts(spark, tmp_path):
    rows = [*SUPPLIERS, (None, None, None), (251, "", -0.25), (750, "n", 2.0)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_acctbal double").repartition(3).write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(map(repr, on_cluster(tmp_path, "db_ingest_inferred"))) == sorted(repr([k, b]) for k, _, b in rows)
