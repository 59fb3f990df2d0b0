"""Queries of sources, reports, interop and execution over the driver's tables, with the SQL that gives the same.

What these operators take or give on the driver (texts in memory, workbooks, reports, records) is small by definition, so the small
tables are used whole.
"""

from __future__ import annotations

import json
import tempfile
import zipfile
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path
from xml.sax.saxutils import escape

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline import api, cdc
from strataline.common import scratch_path, table
from strataline.execution import ExecutionEngine, ExecutionOptions
from strataline.functions.aggregates import GROUP_OPS, REDUCE_OPS
from strataline.operators.change_feed import apply_changes
from strataline.operators.dataset import Dataset
from strataline.operators.frame import Frame
from strataline.plans.catalogue import _SQL, query_of
from strataline.quality import outliers
from strataline.sources import readers
from strataline.sources.observers import CompositeObserver, IngestSeverity, Observer, severity_of
from strataline.types import Schema, schema_of


def _file(spark: SparkSession, suffix: str) -> str:
    """A new local path in the shared folder; its folder exists."""
    path = Path(scratch_path(spark).removeprefix("file://") + suffix)
    path.parent.mkdir(parents=True, exist_ok=True)
    return str(path)


def _rows(df: DataFrame) -> list[list]:
    return [list(r) for r in df.collect()]


NATION = [("n_nationkey", "int64"), ("n_name", "utf8"), ("n_regionkey", "int64")]
_NATION_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey,n_name,CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


def _nation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(*[n for n, _ in NATION])


# Workbooks


def _workbook(spark: SparkSession, sheets: dict[str, tuple[list[str], list[list]]]) -> str:
    path = _file(spark, ".xlsx")
    ids = {name: f"r{i}" for i, name in enumerate(sheets)}
    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{escape(n)}" r:id="{i}"/>' for n, i in ids.items())
        book.writestr("xl/workbook.xml", f'<workbook xmlns:r="r"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{i}" Target="worksheets/{i}.xml"/>' for i in ids.values()) + "</Relationships>")
        for name, (header, rows) in sheets.items():
            lines = []
            for r, cells in enumerate([header, *rows], 1):
                texts = [f"<v>{c}</v>" if isinstance(c, int | float) else f"<is><t>{escape(str(c))}</t></is>" for c in cells]
                kinds = ["" if isinstance(c, int | float) else ' t="inlineStr"' for c in cells]
                lines.append(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + k)}{r}"{kind}>{text}</c>' for k, (kind, text) in enumerate(zip(kinds, texts, strict=True))) + "</row>")
            book.writestr(f"xl/worksheets/{ids[name]}.xml", f"<worksheet><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return path


def _two_sheets(spark: SparkSession, d: str) -> str:
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    return _workbook(spark, {
        "Nations": (["key", "name"], _rows(table(spark, d, "nation").select("n_nationkey", "n_name"))),
        "Regions": (["key", "name", "big"], [[k, n, 2**53 + 1 + k] for k, n in _rows(region)]),
    })


@query_of("excel_all_sheets", "SELECT CAST(n_nationkey AS BIGINT) AS key,n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT),r_name FROM region")
def _(spark, d):
    return readers.ingest_from_path(spark, _two_sheets(spark, d), [("key", "int64"), ("name", "utf8")], {"excel_sheet_selection": {"mode": "all"}}).df


@query_of("excel_one_sheet", "SELECT CAST(r_regionkey AS BIGINT) AS key,CAST(9007199254740993+r_regionkey AS BIGINT) AS big,CAST(9007199254740993+r_regionkey AS VARCHAR) AS text FROM region")
def _(spark, d):
    path = _two_sheets(spark, d)
    numbers = readers.ingest_from_path(spark, path, [("key", "int64"), ("big", "int64")], {"sheets": "Regions"}).df
    texts = readers.ingest_from_path(spark, path, [("key", "int64"), ("big", "utf8")], {"sheets": ["Regions"]}).df
    return numbers.join(texts.withColumnRenamed("big", "text"), "key")


@query_of("excel_infer", "SELECT * FROM (VALUES ('key','int64'),('name','utf8')) t(name,data_type)")
def _(spark, d):
    found = readers.infer_schema(spark, _two_sheets(spark, d))
    return spark.createDataFrame([(f["name"], f["data_type"]) for f in found.to_list()], "name string, data_type string")


# JSON and CSV


@query_of("json_text", _NATION_SQL)
def _(spark, d):
    text = "\n".join(_nation(spark, d).toJSON().collect())
    return readers.read_json_text(spark, text, Schema.of(NATION))


@query_of("json_array_file", "SELECT CAST(n_nationkey AS BIGINT) AS id,n_name AS \"name.text\" FROM nation")
def _(spark, d):
    path = _file(spark, ".json")
    Path(path).write_text(json.dumps([{"id": k, "name": {"text": n}} for k, n, _ in _rows(_nation(spark, d))]))
    return readers.ingest_from_path(spark, path, [("id", "int64"), ("name.text", "utf8")]).df


@query_of("infer_json_schema", "SELECT * FROM (VALUES ('active','bool'),('grp','utf8'),('id','int64'),('score','float64')) t(name,data_type)")
def _(spark, d):
    path = scratch_path(spark) + ".ndjson"
    table(spark, d, "people").select("id", "score", "active", "grp").write.json(path)
    return spark.createDataFrame([(f["name"], f["data_type"]) for f in readers.infer_schema(spark, path).to_list()], "name string, data_type string")


@query_of("csv_text", _NATION_SQL)
def _(spark, d):
    lines = [",".join(n for n, _ in NATION), *(",".join(f'"{c}"' for c in r) for r in _rows(_nation(spark, d)))]
    return readers.read_csv_text(spark, "\n".join(lines), Schema.of(NATION))


@query_of("csv_split_files", "SELECT o_orderkey,o_totalprice,o_orderstatus FROM orders")
def _(spark, d):
    path = scratch_path(spark)
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.option("header", True).csv(path)
    # No cell holds a line break, so files may be split.
    return readers.ingest_from_path(spark, path, [("o_orderkey", "int64"), ("o_totalprice", "float64"), ("o_orderstatus", "utf8")], {"format": "csv", "multi_line": False}).df


@query_of("csv_lossy", "SELECT o_orderkey,TRY_CAST(o_orderpriority AS BIGINT) AS o_orderpriority FROM orders")
def _(spark, d):
    path = scratch_path(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority").write.option("header", True).csv(path)
    return readers.ingest_from_path(spark, path, [("o_orderkey", "int64"), ("o_orderpriority", "int64")], {"format": "csv", "mode": "lossy"}).df


@query_of("ingest_inferred", "SELECT s_suppkey,s_name,CAST(s_nationkey AS BIGINT) AS s_nationkey,s_acctbal FROM supplier")
def _(spark, d):
    data, schema = readers.ingest_with_inferred_schema(spark, f"{d}/supplier.parquet")
    return data.df.select(*schema.names)


@query_of("ingest_request", "SELECT s_suppkey,s_acctbal FROM supplier")
def _(spark, d):
    return readers.IngestRequest(f"{d}/supplier.parquet", [("s_suppkey", "int64"), ("s_acctbal", "float64")], readers.IngestOptions().with_(format="parquet")).run(spark).df


@query_of("detect_formats", "SELECT * FROM (VALUES ('a.CSV','csv'),('b.pq','parquet'),('c.ndjson','json'),('d.xlsm','excel'),('e.txt','refused')) t(path,format)")
def _(spark, d):
    def found(path: str) -> str:
        try:
            return readers.detect_format(path)
        except readers.SchemaMismatch:
            return "refused"

    return spark.createDataFrame([(p, found(p)) for p in ("a.CSV", "b.pq", "c.ndjson", "d.xlsm", "e.txt")], "path string, format string")


# Databases: an embedded one, which comes with Spark. Every executor opens it, so it lies in a jar file of the shared folder, where Derby only
# reads: one in memory is seen by the process that made it alone, and a folder can be opened by one process at a time.

SUPPLIER = {"s_suppkey": "BIGINT", "s_name": "CLOB", "s_acctbal": "DOUBLE"}


def _database(spark: SparkSession, d: str) -> str:
    """URL of a database that has the suppliers. Tasks write them as lines, which the driver's Derby imports file by file."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("s_name"), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.coalesce(quoted if n == "s_name" else F.col(n).cast("string"), F.lit("")) for n in SUPPLIER]  # nothing is null, "" an empty text
    lines = scratch_path(spark)
    table(spark, d, "supplier").select(F.concat_ws(",", *cells)).write.text(lines)
    connect, jar = spark._jvm.java.sql.DriverManager.getConnection, _file(spark, ".jar")
    with tempfile.TemporaryDirectory() as own:
        with closing(connect(f"jdbc:derby:{own}/db;create=true")) as held, closing(held.createStatement()) as does:
            does.execute(f"CREATE TABLE supplier ({','.join(f'"{n}" {kind}' for n, kind in SUPPLIER.items())})")
            for part in sorted(Path(lines.removeprefix("file://")).glob("part-*")):
                does.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL,'SUPPLIER','{part}',',','\"','UTF-8',0)")
                part.unlink()
        try:
            connect(f"jdbc:derby:{own}/db;shutdown=true")
        except Py4JJavaError as e:  # 08006 says that it is shut down, with nothing left to recover
            if e.java_exception.getSQLState() != "08006":
                raise
        with zipfile.ZipFile(jar, "w") as packed:  # stored as they are, so that pages are found without unpacking
            for path in sorted(p for p in Path(own).rglob("*") if p.is_file()):
                packed.write(path, path.relative_to(own))
    return f"jdbc:derby:jar:({jar})db"


@query_of("db_ingest", "SELECT s_suppkey,s_name,s_acctbal FROM supplier WHERE s_acctbal>0")
def _(spark, d):
    sql = 'SELECT "s_suppkey","s_name","s_acctbal" FROM supplier WHERE "s_acctbal">0'
    return api.ingest_from_db(spark, _database(spark, d), sql, [("s_suppkey", "int64"), ("s_name", "utf8"), ("s_acctbal", "float64")]).df


@query_of("db_ingest_inferred", "SELECT s_suppkey,s_acctbal FROM supplier")
def _(spark, d):
    split = {"partitionColumn": "s_suppkey", "lowerBound": "1", "upperBound": "1000", "numPartitions": "4"}
    return readers.ingest_from_db_infer(spark, _database(spark, d), 'SELECT "s_suppkey","s_acctbal" FROM supplier', split).df


# In memory and interop


@query_of("in_memory", _NATION_SQL)
def _(spark, d):
    return api.make_dataset(spark, NATION, _rows(_nation(spark, d).selectExpr("cast(n_nationkey as bigint)", "n_name", "cast(n_regionkey as bigint)"))).df


@query_of("arrow_round_trip", "SELECT c_custkey,c_name,c_acctbal FROM customer")
def _(spark, d):
    return Dataset.from_arrow(spark, Dataset(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")).to_arrow()).df


@dataclass
class _Nation:
    n_nationkey: int
    n_name: str
    n_regionkey: int


@query_of("records_round_trip", _NATION_SQL)
def _(spark, d):
    return Dataset.from_records(spark, NATION, Dataset(_nation(spark, d)).to_records(_Nation)).df


@query_of("change_event_types", "SELECT 'geo' AS source,'region' AS table_name,CAST(r_regionkey AS BIGINT) AS row_id,CAST(r_regionkey+10 AS VARCHAR) AS checkpoint_token,upper(r_name) AS name FROM region WHERE r_regionkey<>2")
def _(spark, d):
    class Feed:
        """Two batches: an insert of every row, then an update of every row but one, which is deleted."""

        def __init__(self, rows):
            self.left = [[self.event(k, k, n, cdc.CdcOp.INSERT) for k, n in rows], [self.event(10 + k, k, n.upper(), cdc.CdcOp.DELETE if k == 2 else cdc.CdcOp.UPDATE) for k, n in rows]]

        @staticmethod
        def event(at, key, name, op):
            image = cdc.RowImage.new([("id", key), ("name", name)])
            meta = cdc.SourceMeta("geo", cdc.CdcCheckpoint(str(at)))
            return cdc.CdcEvent(meta, cdc.TableRef.with_schema("public", "region"), op, image if op is cdc.CdcOp.DELETE else None, None if op is cdc.CdcOp.DELETE else image)

        def next_batch(self):
            return self.left.pop(0) if self.left else None

    events = [e for batch in cdc.batches(Feed(_rows(table(spark, d, "region").select("r_regionkey", "r_name")))) for e in batch]
    now = apply_changes(cdc.to_frame(spark, events))
    return now.select("source", "table_name", "row_id", "checkpoint_token", F.col("image")["name"].alias("name"))


@query_of("frame_schema", "SELECT * FROM (VALUES ('run_id','int64','int64'),('tasks','refused','utf8')) t(name,strict,lossy)")
def _(spark, d):
    df = table(spark, d, "job_runs_sample").select("run_id", "tasks")

    def strict(name: str) -> str:
        try:
            return schema_of(df.select(name)).fields[0].data_type.value
        except readers.SchemaMismatch:
            return "refused"

    return spark.createDataFrame([(f.name, strict(f.name), f.data_type.value) for f in schema_of(df, strict=False).fields], "name string, strict string, lossy string")


@query_of("collect_with_schema", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey,CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(spark, d):
    return Frame(table(spark, d, "customer")).collect_with_schema(Schema.of([("c_custkey", "float64"), ("c_nationkey", "utf8")])).df


# Reductions of datasets and reports


@query_of("dataset_reductions", " UNION ALL ".join(f"SELECT '{op}' AS op,round({sql},{ {'var_pop': 0, 'var_samp': 0, 'sumsq': -3}.get(op, 2) }) AS value FROM lineitem" for op, sql in _SQL.items()))
def _(spark, d):
    data, names = Dataset(table(spark, d, "lineitem").select("l_extendedprice")), {v: k for k, v in REDUCE_OPS.items()}
    rows = [(op, float(data.reduce("l_extendedprice", names[op]))) for op in _SQL]
    rounded = F.when(F.col("op").isin("var_pop", "var_samp"), F.round("value", 0)).when(F.col("op") == "sumsq", F.round("value", -3)).otherwise(F.round("value", 2))
    return spark.createDataFrame(rows, "op string, value double").withColumn("value", rounded)


@query_of("dataset_empty_sums", "SELECT * FROM (VALUES ('dataset',NULL::DOUBLE),('frame',0.0)) t(mode,value)")
def _(spark, d):
    none = table(spark, d, "lineitem").select(F.lit(None).cast("double").alias("x"))
    return spark.createDataFrame([("dataset", Dataset(none).reduce("x", "sum")), ("frame", float(Frame(none).reduce("x", "sum")))], "mode string, value double")


@query_of("feature_stats_rows", "SELECT 'l_tax' AS \"column\",round(avg(l_tax),6) AS mean,round(stddev_pop(l_tax),6) AS std FROM lineitem UNION ALL SELECT 'l_quantity',round(avg(l_quantity),6),round(stddev_pop(l_quantity),6) FROM lineitem")
def _(spark, d):
    found = api.processing_feature_wise_mean_std(Dataset(table(spark, d, "lineitem").select("l_tax", "l_quantity")), ["l_tax", "l_quantity"], "population")
    return spark.createDataFrame([(c, round(s["mean"], 6), round(s["std"], 6)) for c, s in found.items()], "column string, mean double, std double")


@query_of("fold_in_order", "SELECT count(*) AS n,string_agg(n_name,'>' ORDER BY n_nationkey) AS path FROM nation")
def _(spark, d):
    path = Dataset(_nation(spark, d), order_by=["n_nationkey"]).fold([], lambda seen, row: [*seen, row[1]])
    return spark.createDataFrame([(len(path), ">".join(path))], "n bigint, path string")


@query_of("validate_report", """
SELECT 'not_null' AS kind,count(*)-count(n) AS failed,'Warn' AS severity,'' AS examples FROM (SELECT nullif(l_linenumber,1) AS n FROM lineitem)
UNION ALL SELECT 'range',count(*) FILTER (WHERE l_quantity<2),'Error',(SELECT string_agg(x,',') FROM (SELECT CAST(l_quantity AS VARCHAR) AS x FROM lineitem WHERE l_quantity<2 ORDER BY l_orderkey*10+l_linenumber LIMIT 3)) FROM lineitem
UNION ALL SELECT 'in_set',count(*) FILTER (WHERE l_discount NOT IN (0.0,0.05)),'Info',(SELECT string_agg(x,',') FROM (SELECT CAST(l_discount AS VARCHAR) AS x FROM lineitem WHERE l_discount NOT IN (0.0,0.05) ORDER BY l_orderkey*10+l_linenumber LIMIT 3)) FROM lineitem
""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.nullif("l_linenumber", F.lit(1)).alias("n"), "l_quantity", "l_discount")
    spec = {"max_examples": 3, "checks": [
        {"kind": "not_null", "column": "n", "severity": "warn"}, {"kind": "range", "column": "l_quantity", "min": 2.0, "max": 1e9}, {"kind": "in_set", "column": "l_discount", "values": [0.0, 0.05], "severity": "info"},
    ]}
    report = api.validate_dataset(Dataset(rows, order_by=["at"]), spec)
    kinds = [c["kind"] for c in spec["checks"]]
    severities = [r["check"].rpartition("severity=")[2].rstrip(")").capitalize() for r in report["results"]]
    out = [(k, r["failed_count"], s, ",".join(str(x) for x in r["examples"] if x is not None)) for k, s, r in zip(kinds, severities, report["results"], strict=True)]
    return spark.createDataFrame(out, "kind string, failed bigint, severity string, examples string")


@query_of("validate_summary", "SELECT 3 AS total_checks,2 AS failed_checks,'Error' AS max_severity")
def _(spark, d):
    checks = [{"kind": "not_null", "column": "c_custkey"}, {"kind": "range", "column": "c_acctbal", "min": 0, "max": 1}, {"kind": "regex", "column": "c_name", "pattern": "^$", "severity": "info"}]
    s = api.validate_dataset(Dataset(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name")), {"checks": checks})["summary"]
    return spark.createDataFrame([(s["total_checks"], s["failed_checks"], s["max_severity"])], "total_checks int, failed_checks int, max_severity string")


@query_of("profile_report", "SELECT 'l_quantity' AS name,'float64' AS data_type,count(*) AS row_count,count(*)-count(l_quantity) AS null_count,count(DISTINCT l_quantity) AS distinct_count,min(l_quantity) AS lo,max(l_quantity) AS hi FROM lineitem UNION ALL SELECT 'l_returnflag','utf8',count(*),count(*)-count(l_returnflag),count(DISTINCT l_returnflag),NULL,NULL FROM lineitem")
def _(spark, d):
    report = api.profile_dataset(Dataset(table(spark, d, "lineitem").select("l_quantity", "l_returnflag")), {"quantiles": [0.5]})
    rows = [(c["name"], c["data_type"], report["row_count"], c["null_count"], c["distinct_count"], (c["numeric"] or {}).get("min"), (c["numeric"] or {}).get("max")) for c in report["columns"]]
    return spark.createDataFrame(rows, "name string, data_type string, row_count bigint, null_count bigint, distinct_count bigint, lo double, hi double")


@query_of("outlier_report", "WITH s AS (SELECT avg(c_acctbal) m,stddev_samp(c_acctbal) sd FROM customer),o AS (SELECT c_custkey,c_acctbal FROM customer,s WHERE abs((c_acctbal-m)/sd)>1.5) SELECT (SELECT count(*) FROM customer) AS row_count,(SELECT count(*) FROM o) AS outlier_count,(SELECT string_agg(CAST(c_acctbal AS VARCHAR),',' ORDER BY c_custkey) FROM (SELECT * FROM o ORDER BY c_custkey LIMIT 4)) AS examples")
def _(spark, d):
    data = Dataset(table(spark, d, "customer").select("c_custkey", "c_acctbal"), order_by=["c_custkey"])
    r = outliers.detect(data, "c_acctbal", {"kind": "z_score", "threshold": 1.5}, max_examples=4)
    return spark.createDataFrame([(r.row_count, r.outlier_count, ",".join(map(str, r.examples)))], "row_count bigint, outlier_count bigint, examples string")


@query_of("option_aliases", "SELECT * FROM (VALUES ('std_dev_sample','std_samp'),('count_distinct','distinct'),('group:stddev','std')) t(name,op)")
def _(spark, d):
    return spark.createDataFrame([("std_dev_sample", REDUCE_OPS["std_dev_sample"]), ("count_distinct", REDUCE_OPS["count_distinct"]), ("group:stddev", GROUP_OPS["stddev"])], "name string, op string")


@query_of("flat_sql", "SELECT c_mktsegment,count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    return api.sql_query_dataset(Dataset(table(spark, d, "customer")), "SELECT c_mktsegment,count(*) AS n FROM df GROUP BY c_mktsegment").df



# Execution and observers


@query_of("execution_metrics", "SELECT count(*) AS rows_processed,CAST(ceil(count(*)/10.0) AS BIGINT) AS chunks,1 AS most_at_once,CAST(sum(n_nationkey) AS DOUBLE) AS total FROM nation")
def _(spark, d):
    engine = ExecutionEngine(ExecutionOptions(chunk_size=10, max_in_flight_chunks=1))
    kept = engine.map_parallel(Dataset(_nation(spark, d)), lambda r: r)
    m = engine.metrics_snapshot()
    return spark.createDataFrame([(m.rows_processed, m.chunks_finished, m.max_active_chunks, float(engine.reduce(kept, "n_nationkey", "sum")))], "rows_processed bigint, chunks bigint, most_at_once int, total double")


@query_of("execution_events", "SELECT * FROM (VALUES ('run_started',1),('throttle_waited',1),('chunk_started',3),('chunk_finished',3),('run_finished',1)) t(kind,n)")
def _(spark, d):
    seen: list[str] = []
    ExecutionEngine(ExecutionOptions(chunk_size=10, num_threads=1), lambda e: seen.append(e.kind)).filter_parallel(Dataset(_nation(spark, d)), lambda r: True)
    return spark.createDataFrame([(k, seen.count(k)) for k in dict.fromkeys(seen)], "kind string, n int")


@query_of("ingest_observers", "SELECT * FROM (SELECT 1 AS at,'success' AS event,CAST(count(*) AS VARCHAR) AS detail FROM nation UNION ALL SELECT 2,'failure','ERROR' UNION ALL SELECT 3,'failure','CRITICAL' UNION ALL SELECT 4,'alert','CRITICAL')")
def _(spark, d):
    class Recorder(Observer):
        def __init__(self):
            self.seen: list[tuple[str, str]] = []

        def on_success(self, context, rows):
            self.seen.append(("success", str(rows)))

        def on_failure(self, context, severity, error):
            self.seen.append(("failure", severity.name))

        def on_alert(self, context, severity, error):
            self.seen.append(("alert", severity.name))

    watch = Recorder()
    options = readers.IngestOptions(observer=CompositeObserver([watch]))
    readers.ingest_from_path(spark, f"{d}/nation.parquet", [("n_name", "utf8")], options)
    for path, schema in ((f"{d}/nation.parquet", [("nope", "utf8")]), (f"{d}/missing.parquet", [("n_name", "utf8")])):
        try:
            readers.ingest_from_path(spark, path, schema, options)
        except (readers.SchemaMismatch, readers.IngestIOError):
            pass
    return spark.createDataFrame([(i, *x) for i, x in enumerate(watch.seen, 1)], "at int, event string, detail string")


@query_of("severity_rules", "SELECT * FROM (VALUES ('missing file','CRITICAL'),('caused by one','CRITICAL'),('bad value','ERROR'),('warn','WARNING')) t(\"case\",severity)")
def _(spark, d):
    caused = ValueError("x")
    caused.__cause__ = FileNotFoundError("y")
    rows = [("missing file", severity_of(FileNotFoundError("x"))), ("caused by one", severity_of(caused)), ("bad value", severity_of(ValueError("x"))), ("warn", IngestSeverity.parse("warn"))]
    return spark.createDataFrame([(k, s.name) for k, s in rows], "case string, severity string")
