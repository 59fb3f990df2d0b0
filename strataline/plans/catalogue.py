"""Queries of the engine's own operators over the driver's tables, with the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.common import scratch_path, table
from strataline.functions.aggregates import REDUCE_OPS
from strataline.operators.dataset import Dataset
from strataline.operators.frame import Frame
from strataline.plans.sql_context import SqlContext, query
from strataline.plans.transform import TransformSpec
from strataline.quality import outliers, profile, validate
from strataline.streaming.change_stream import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, derive and sum: the shape of the headline benchmark, on lineitem."""
    rows = Frame(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice"))
    kept = rows.filter_eq("l_returnflag", "N").filter_mod_eq_int64("l_linenumber", 2, 0).with_mul_f64("price", "l_extendedprice", 1.1)
    return kept.df.agg(F.round(F.sum("price"), 3).alias("value"))


def query_of(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def frame(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Frame:
    df = table(spark, sf_dir, name)
    return Frame(df.select(*columns) if columns else df)


query_of("flagship", "SELECT round(sum(l_extendedprice*1.1),3) AS value FROM lineitem WHERE l_returnflag='N' AND l_linenumber%2=0")(flagship)

LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


# Predicates. Nulls are made in the query, as the tables have none.
@query_of("filter_eq", "SELECT l_orderkey,CAST(l_linenumber AS BIGINT) AS l_linenumber,l_returnflag FROM lineitem WHERE l_returnflag='R'")
def _(spark, d):
    return frame(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").filter_eq("l_returnflag", "R").df


def _with_null(spark, d):
    return Frame(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(1)).alias("n")))


@query_of("filter_null_eq", "SELECT l_orderkey,CAST(l_linenumber AS BIGINT) AS l_linenumber,CAST(nullif(l_linenumber,1) AS BIGINT) AS n FROM lineitem WHERE nullif(l_linenumber,1) IS NULL")
def _(spark, d):
    return _with_null(spark, d).filter_eq("n", None).df


@query_of("filter_not_null", "SELECT l_orderkey,CAST(l_linenumber AS BIGINT) AS l_linenumber,CAST(nullif(l_linenumber,1) AS BIGINT) AS n FROM lineitem WHERE nullif(l_linenumber,1) IS NOT NULL")
def _(spark, d):
    return _with_null(spark, d).filter_not_null("n").df


@query_of("filter_mod", "SELECT l_orderkey,CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_orderkey%7=3")
def _(spark, d):
    return frame(spark, d, "lineitem", "l_orderkey", "l_linenumber").filter_mod_eq_int64("l_orderkey", 7, 3).df


# Projections
@query_of("select_reorder", "SELECT c_name,c_custkey FROM customer")
def _(spark, d):
    return frame(spark, d, "customer").select(["c_name", "c_custkey"]).df


@query_of("rename_cols", "SELECT c_custkey AS id,c_name AS name,c_acctbal FROM customer")
def _(spark, d):
    return frame(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").rename([("c_custkey", "id"), ("c_name", "name")]).df


@query_of("drop_cols", "SELECT s_suppkey,s_name FROM supplier")
def _(spark, d):
    return frame(spark, d, "supplier").drop(["s_nationkey", "s_acctbal"]).df


@query_of("with_literal", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey,'v1' AS tag,CAST(7 AS BIGINT) AS seven FROM region")
def _(spark, d):
    return frame(spark, d, "region", "r_regionkey").with_literal("tag", "v1").with_literal("seven", 7).df


@query_of("fill_null", "SELECT l_orderkey,CAST(l_linenumber AS BIGINT) AS l_linenumber,CAST(coalesce(nullif(l_linenumber,1),0) AS BIGINT) AS n FROM lineitem")
def _(spark, d):
    return _with_null(spark, d).fill_null("n", 0).df


@query_of("cast_strict", "SELECT o_orderkey,CAST(o_orderkey AS VARCHAR) AS t,CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE) AS x FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("t"), F.col("o_orderkey").cast("string").alias("x"))
    return Frame(df).cast("t", "utf8").cast("x", "float64").df


@query_of("cast_lossy", "SELECT o_orderkey,TRY_CAST(substr(o_orderpriority,1,1) AS BIGINT) AS a,TRY_CAST(o_orderpriority AS BIGINT) AS b FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("a"), F.col("o_orderpriority").alias("b"))
    return Frame(df).cast("a", "int64", "lossy").cast("b", "int64", "lossy").df


@query_of("derive_mul_add", "SELECT l_orderkey,CAST(l_linenumber AS BIGINT) AS l_linenumber,round(l_extendedprice*1.1,4) AS m,round(l_extendedprice+2.5,4) AS a,round(l_quantity*2.0,4) AS l_quantity FROM lineitem")
def _(spark, d):
    f = frame(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    f = f.with_mul_f64("m", "l_extendedprice", 1.1).with_add_f64("a", "l_extendedprice", 2.5).multiply_f64("l_quantity", 2.0).drop(["l_extendedprice"])
    return f.df.withColumns({c: F.round(c, 4) for c in ("m", "a", "l_quantity")})


# Scalar reductions
_SQL = {
    "count": "CAST(count(*) AS DOUBLE)", "sum": "sum(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "mean": "avg(l_extendedprice)",
    "var_pop": "var_pop(l_extendedprice)", "var_samp": "var_samp(l_extendedprice)", "std_pop": "stddev_pop(l_extendedprice)", "std_samp": "stddev_samp(l_extendedprice)",
    "sumsq": "sum(l_extendedprice*l_extendedprice)", "l2": "sqrt(sum(l_extendedprice*l_extendedprice))", "distinct": "CAST(count(DISTINCT l_extendedprice) AS DOUBLE)",
}
#: Places to which results are rounded where sums are huge.
_PLACES = {"var_pop": 0, "var_samp": 0, "sumsq": -3}


def _reduction(op: str, name: str):
    places = _PLACES.get(op, 2)

    def run(spark, d):
        return frame(spark, d, "lineitem", "l_extendedprice").reduce_frame("l_extendedprice", name).select(F.round(F.col("value").cast("double"), places).alias("value"))

    query_of(f"reduce_{op}", f"SELECT round({_SQL[op]},{places}) AS value FROM lineitem")(run)


for _op in _SQL:
    _reduction(_op, next(k for k, v in REDUCE_OPS.items() if v == _op))


@query_of(
    "feature_stats",
    "SELECT 'l_quantity' AS \"column\",round(avg(l_quantity),4) AS mean,round(stddev_samp(l_quantity),4) AS std FROM lineitem UNION ALL "
    "SELECT 'l_discount',round(avg(l_discount),4),round(stddev_samp(l_discount),4) FROM lineitem",
)
def _(spark, d):
    return frame(spark, d, "lineitem", "l_quantity", "l_discount").feature_stats(["l_quantity", "l_discount"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


# Groups
_AGGS = [
    {"type": "count_rows", "alias": "n"}, {"type": "count_not_null", "column": "m", "alias": "nn"}, {"type": "sum", "column": "l_quantity", "alias": "s"},
    {"type": "min", "column": "l_quantity", "alias": "lo"}, {"type": "max", "column": "l_quantity", "alias": "hi"}, {"type": "mean", "column": "l_extendedprice", "alias": "mean"},
    {"type": "variance", "column": "l_quantity", "alias": "v"}, {"type": "std_dev", "column": "l_quantity", "kind": "population", "alias": "sd"},
    {"type": "sum_squares", "column": "l_discount", "alias": "sq"}, {"type": "l2_norm", "column": "l_discount", "alias": "l2"},
    {"type": "count_distinct_non_null", "column": "m", "alias": "u"},
]


@query_of(
    "group_all_aggs",
    "SELECT l_returnflag,count(*) AS n,count(nullif(l_linenumber,1)) AS nn,round(sum(l_quantity),2) AS s,min(l_quantity) AS lo,max(l_quantity) AS hi,"
    "round(avg(l_extendedprice),3) AS mean,round(var_samp(l_quantity),4) AS v,round(stddev_pop(l_quantity),4) AS sd,round(sum(l_discount*l_discount),4) AS sq,"
    "round(sqrt(sum(l_discount*l_discount)),4) AS l2,count(DISTINCT nullif(l_linenumber,1)) AS u FROM lineitem GROUP BY l_returnflag",
)
def _(spark, d):
    df = table(spark, d, "lineitem").select(*LINE, F.nullif("l_linenumber", F.lit(1)).alias("m"))
    out = Frame(df).group_by(["l_returnflag"], _AGGS).df
    return out.withColumns({"s": F.round("s", 2), "mean": F.round("mean", 3)} | {c: F.round(c, 4) for c in ("v", "sd", "sq", "l2")})


@query_of("group_multi_key", "SELECT l_returnflag,l_linestatus,count(*) AS n,round(sum(l_extendedprice),2) AS s FROM lineitem GROUP BY ALL")
def _(spark, d):
    f = frame(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice")
    return f.group_by(["l_returnflag", "l_linestatus"], [{"type": "count_rows", "alias": "n"}, {"type": "sum", "column": "l_extendedprice", "alias": "s"}]).df.withColumn("s", F.round("s", 2))


@query_of("group_all_null_sum", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber,coalesce(sum(CASE WHEN l_linenumber<>2 THEN l_quantity END),0) AS s,avg(CASE WHEN l_linenumber<>2 THEN l_quantity END) AS m FROM lineitem GROUP BY l_linenumber")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"))
    return Frame(df).group_by(["l_linenumber"], [{"type": "sum", "column": "q", "alias": "s"}, {"type": "mean", "column": "q", "alias": "m"}]).df


@query_of("group_null_key", "SELECT CAST(nullif(l_linenumber,1) AS BIGINT) AS n,count(*) AS c FROM lineitem GROUP BY 1")
def _(spark, d):
    return _with_null(spark, d).group_by(["n"], [{"type": "count_rows", "alias": "c"}]).df


# Joins
def _join(how: str, sql: str) -> None:
    def run(spark, d):
        left = Frame(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_name").alias("name")).filter("c_nationkey < 15"))
        right = Frame(table(spark, d, "nation").select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("name")).filter("n_nationkey > 5"))
        return left.join(right, ["k"], ["k2"], how).df

    cols = {"right": "n_nationkey", "full": "coalesce(c_nationkey,n_nationkey)"}.get(how, "c_nationkey")
    query_of(
        f"join_{how}",
        f"SELECT c_custkey,CAST({cols} AS BIGINT) AS k,c_name AS name,n_name AS name_right FROM (SELECT * FROM customer WHERE c_nationkey<15) c {sql} JOIN (SELECT * FROM nation WHERE n_nationkey>5) n ON c_nationkey=n_nationkey",
    )(run)


for _how, _sql in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _join(_how, _sql)


@query_of("join_multi_key", "SELECT a.l_orderkey,CAST(a.l_linenumber AS BIGINT) AS l_linenumber,a.l_quantity,b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_linenumber=b.l_linenumber")
def _(spark, d):
    a = frame(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return a.join(frame(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"]).df


# Rows in order
_ORDINAL = "SELECT row_number() OVER (ORDER BY o_orderkey)-1 AS row,o_totalprice AS x FROM orders"


def _arg(which: str, sql: str) -> None:
    def run(spark, d):
        rows = Dataset(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")), order_by=["o_orderkey"])
        found = rows.arg_max_row("x") if which == "max" else rows.arg_min_row("x")
        return spark.createDataFrame([found] if found else [], "row bigint, x double")

    query_of(f"arg_{which}", f"SELECT row,x FROM ({_ORDINAL}) ORDER BY x {sql},row LIMIT 1")(run)


_arg("max", "DESC")
_arg("min", "ASC")


@query_of("topk_freq", "SELECT CAST(p_size AS BIGINT) AS value,count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC,1 LIMIT 10")
def _(spark, d):
    return Dataset(table(spark, d, "part").select("p_size")).top_k_frame("p_size", 10)


@query_of("filter_rows", "SELECT c_custkey,c_acctbal FROM customer WHERE c_acctbal>5000")
def _(spark, d):
    return Dataset(table(spark, d, "customer").select("c_custkey", "c_acctbal")).filter(lambda r: r[1] is not None and r[1] > 5000).df


@query_of("map_rows", "SELECT c_custkey*2 AS c_custkey,upper(c_mktsegment) AS c_mktsegment FROM customer")
def _(spark, d):
    return Dataset(table(spark, d, "customer").select("c_custkey", "c_mktsegment")).map(lambda r: [r[0] * 2, r[1].upper()]).df


# SQL and transformations
@query_of("sql_select_order_limit", "SELECT o_orderkey,o_totalprice FROM orders WHERE o_orderstatus='F' AND o_totalprice>1000 ORDER BY o_totalprice DESC,o_orderkey LIMIT 25")
def _(spark, d):
    return query(frame(spark, d, "orders"), "SELECT o_orderkey,o_totalprice FROM df WHERE o_orderstatus='F' AND o_totalprice>1000 ORDER BY o_totalprice DESC,o_orderkey LIMIT 25").df


@query_of("sql_group_having", "SELECT o_custkey,count(*) AS n,round(sum(o_totalprice),2) AS s FROM orders GROUP BY o_custkey HAVING count(*)>12")
def _(spark, d):
    return query(frame(spark, d, "orders"), "SELECT o_custkey,count(*) AS n,round(sum(o_totalprice),2) AS s FROM df GROUP BY o_custkey HAVING count(*)>12").df


@query_of("sql_join", "SELECT n.n_name,count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey WHERE c.c_acctbal IS NOT NULL GROUP BY n.n_name")
def _(spark, d):
    context = SqlContext()
    context.register("c", frame(spark, d, "customer"))
    context.register("n", frame(spark, d, "nation"))
    return context.execute("SELECT n.n_name,count(*) AS n FROM c JOIN n ON c.c_nationkey=n.n_nationkey WHERE c.c_acctbal IS NOT NULL GROUP BY n.n_name").df


@query_of("transform_spec", "SELECT c_custkey AS id,CAST(c_nationkey AS VARCHAR) AS key,round(c_acctbal*1.5,4) AS scaled,'x' AS tag FROM customer")
def _(spark, d):
    spec = TransformSpec.build(
        [("id", "int64"), ("key", "utf8"), ("scaled", "float64"), ("tag", "utf8")],
        [
            ("Select", {"columns": ["c_custkey", "c_acctbal", "c_nationkey", "c_name"]}), ("Rename", {"pairs": [["c_custkey", "id"], ["c_nationkey", "key"]]}), ("Cast", {"column": "key", "to": "Utf8", "mode": "strict"}),
            ("FillNull", {"column": "c_acctbal", "value": {"Float64": 0.0}}), ("DeriveMulF64", {"name": "scaled", "source": "c_acctbal", "factor": 1.5}), ("DeriveAddF64", {"name": "unused", "source": "c_acctbal", "delta": 1.0}),
            ("Drop", {"columns": ["unused", "c_name"]}), ("WithLiteral", {"name": "tag", "value": {"Utf8": "x"}}),
        ],
    )
    out = TransformSpec.from_json(spec.to_json()).apply(Dataset(table(spark, d, "customer"))).df
    return out.withColumn("scaled", F.round("scaled", 4))


# Quality
_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def _profile_sql(rows: str, columns: list[str] = _NUM) -> str:
    one = (
        "SELECT '{c}' AS \"column\",count(*) AS row_count,count(*)-count({c}) AS null_count,count(DISTINCT {c}) AS distinct_count,round(min({c}),4) AS min,round(max({c}),4) AS max,round(avg({c}),4) AS mean,"
        "(SELECT round(x,4) FROM (SELECT {c} AS x,row_number() OVER (ORDER BY {c}) AS r,count(*) OVER () AS n FROM t) WHERE r=CAST(floor((n-1)*0.5+0.5) AS BIGINT)+1) AS q50,"
        "(SELECT round(x,4) FROM (SELECT {c} AS x,row_number() OVER (ORDER BY {c}) AS r,count(*) OVER () AS n FROM t) WHERE r=CAST(floor((n-1)*0.95+0.5) AS BIGINT)+1) AS q95 FROM t"
    )
    return f"WITH t AS ({rows}) " + " UNION ALL ".join(one.format(c=c) for c in columns)


def _profiled(df: DataFrame, columns: list[str] = _NUM) -> DataFrame:
    out = profile.profile_frame(df.select(*columns), [0.5, 0.95]).drop("data_type", "min_int", "max_int").withColumnsRenamed({"q0.5": "q50", "q0.95": "q95"})
    return out.withColumns({c: F.round(c, 4) for c in ("min", "max", "mean", "q50", "q95")})


@query_of("profile_full", _profile_sql("SELECT * FROM lineitem"))
def _(spark, d):
    return _profiled(table(spark, d, "lineitem"))


@query_of("profile_head", _profile_sql("SELECT * FROM events ORDER BY event_id LIMIT 1000", ["user_id", "value"]))
def _(spark, d):
    return _profiled(Dataset(table(spark, d, "events"), order_by=["event_id"]).head(1000), ["user_id", "value"])


@query_of("profile_text", "SELECT 'c_mktsegment' AS \"column\",count(*) AS row_count,count(*)-count(nullif(c_mktsegment,'BUILDING')) AS null_count,count(DISTINCT nullif(c_mktsegment,'BUILDING')) AS distinct_count FROM customer")
def _(spark, d):
    df = table(spark, d, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return profile.profile_frame(df).select("column", "row_count", "null_count", "distinct_count")


@query_of(
    "profile_big_ids",
    "SELECT 'id' AS \"column\",count(*) AS row_count,count(DISTINCT id) AS distinct_count,min(id) AS min_int,max(id) AS max_int FROM (SELECT 9007199254740992+o_orderkey AS id FROM orders)",
)
def _(spark, d):
    ids = table(spark, d, "orders").select((F.lit(2**53) + F.col("o_orderkey")).alias("id"))
    return profile.profile_frame(ids).select("column", "row_count", "distinct_count", "min_int", "max_int")


def _check(name: str, spec: dict, sql: str, source: str = "lineitem", nulls: str | None = None) -> None:
    def run(spark, d):
        df = table(spark, d, source)
        if nulls:
            df = df.withColumn(spec["column"], F.nullif(spec["column"], F.lit(1)))
        return validate.counts_frame(df, [spec]).withColumnRenamed("c0", "failed")

    query_of(f"validate_{name}", f"SELECT CAST({sql} AS BIGINT) AS failed FROM {source}")(run)


_check("not_null", {"kind": "not_null", "column": "l_linenumber"}, "count(*)-count(nullif(l_linenumber,1))", nulls="1")
_check("range", {"kind": "range", "column": "l_quantity", "min": 5, "max": 45}, "count(*) FILTER (WHERE l_quantity<5 OR l_quantity>45)")
_check("regex", {"kind": "regex", "column": "props", "pattern": "\"k\""}, "count(*) FILTER (WHERE NOT regexp_matches(props,'\"k\"'))", "events")
_check("in_set", {"kind": "in_set", "column": "l_returnflag", "values": ["A", "N"]}, "count(*) FILTER (WHERE l_returnflag NOT IN ('A','N'))")
_check("unique", {"kind": "unique", "column": "o_custkey"}, "count(o_custkey)-count(DISTINCT o_custkey)", "orders")


def _outlier(kind: str, value: float, sql: str) -> None:
    def run(spark, d):
        df = table(spark, d, "events").select("value")
        method = outliers.Method.of({"kind": kind, outliers.METHODS[kind][0]: value})
        stats = outliers.stats_frame(df, "value", method)
        one = stats.first().asDict()
        count = df.agg(F.count_if(outliers.outlying(F.col("value").cast("double"), method, one)).alias("outlier_count"))
        shown = {"z_score": ["mean", "std"], "mad": ["median", "mad"], "iqr": ["q1", "q3", "lower_fence", "upper_fence"]}[kind]
        return stats.join(F.broadcast(count)).select("row_count", "outlier_count", *[F.round(s, 4).alias(s) for s in shown])

    query_of(f"outlier_{kind}", sql)(run)


_outlier("z_score", 2.0, "WITH s AS (SELECT avg(value) m,stddev_samp(value) sd FROM events) SELECT count(*) AS row_count,count(*) FILTER (WHERE abs((value-m)/sd)>2.0) AS outlier_count,round(any_value(m),4) AS mean,round(any_value(sd),4) AS std FROM events,s")
_outlier("mad", 2.5, "WITH s AS (SELECT median(value) m FROM events),t AS (SELECT median(abs(value-m)) d FROM events,s) SELECT count(*) AS row_count,count(*) FILTER (WHERE 0.6745*abs(value-m)/d>2.5) AS outlier_count,round(any_value(m),4) AS median,round(any_value(d),4) AS mad FROM events,s,t")
_outlier(
    "iqr", 1.5,
    "WITH r AS (SELECT value AS x,row_number() OVER (ORDER BY value) AS r,count(*) OVER () AS n FROM events WHERE value IS NOT NULL),q AS (SELECT max(CASE WHEN r=CAST(floor((n-1)*0.25+0.5) AS BIGINT)+1 THEN x END) q1,max(CASE WHEN r=CAST(floor((n-1)*0.75+0.5) AS BIGINT)+1 THEN x END) q3 FROM r) "
    "SELECT count(*) AS row_count,count(*) FILTER (WHERE value<q1-1.5*(q3-q1) OR value>q3+1.5*(q3-q1)) AS outlier_count,round(any_value(q1),4) AS q1,round(any_value(q3),4) AS q3,round(any_value(q1-1.5*(q3-q1)),4) AS lower_fence,round(any_value(q3+1.5*(q3-q1)),4) AS upper_fence FROM events,q",
)


# Sources and beyond
@query_of("infer_schema", "SELECT 'c_custkey' AS name,'int64' AS data_type UNION ALL SELECT 'c_name','utf8' UNION ALL SELECT 'c_nationkey','int64' UNION ALL SELECT 'c_acctbal','float64' UNION ALL SELECT 'c_mktsegment','utf8'")
def _(spark, d):
    from strataline.sources.readers import infer_schema

    return spark.createDataFrame([(f["name"], f["data_type"]) for f in infer_schema(spark, f"{d}/customer.parquet").to_list()], "name string, data_type string")


@query_of("parquet_ingest", "SELECT c_acctbal,CAST(c_nationkey AS DOUBLE) AS c_nationkey,c_custkey FROM customer")
def _(spark, d):
    from strataline.sources.readers import ingest_from_path

    return ingest_from_path(spark, f"{d}/customer.parquet", [("c_acctbal", "float64"), ("c_nationkey", "float64"), ("c_custkey", "int64")]).df


@query_of("stream_window_counts", "SELECT date_trunc('hour',ts) AS window_start,event_type,count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"])


@query_of("sort_limit", "SELECT c_custkey,c_acctbal FROM customer ORDER BY c_acctbal DESC,c_custkey LIMIT 20")
def _(spark, d):
    return frame(spark, d, "customer", "c_custkey", "c_acctbal").sort(("c_acctbal", False), ("c_custkey", True)).limit(20).df


@query_of("union_rows", "SELECT CAST(n_nationkey AS BIGINT) AS k,n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT),r_name FROM region")
def _(spark, d):
    a = frame(spark, d, "nation", "n_nationkey", "n_name").rename([("n_nationkey", "k"), ("n_name", "name")])
    return a.union(frame(spark, d, "region", "r_regionkey", "r_name").rename([("r_regionkey", "k"), ("r_name", "name")])).df


@query_of("csv_round_trip", "SELECT c_custkey,c_acctbal,c_mktsegment FROM customer")
def _(spark, d):
    from strataline.sources.readers import ingest_from_path

    path = scratch_path(spark)
    table(spark, d, "customer").write.option("header", True).csv(path)
    return ingest_from_path(spark, path, [("c_custkey", "int64"), ("c_acctbal", "float64"), ("c_mktsegment", "utf8")], {"format": "csv"}).df


@query_of(
    "json_dot_path",
    "SELECT run_id,settings.name AS \"settings.name\",settings.tags.team AS \"settings.tags.team\",cluster.num_workers AS \"cluster.num_workers\",metrics.success AS \"metrics.success\" FROM job_runs_sample",
)
def _(spark, d):
    from strataline.sources.readers import ingest_from_path

    path = scratch_path(spark) + ".ndjson"
    table(spark, d, "job_runs_sample").select("run_id", "settings", "cluster", "metrics").write.json(path)
    fields = [("run_id", "int64"), ("settings.name", "utf8"), ("settings.tags.team", "utf8"), ("cluster.num_workers", "int64"), ("metrics.success", "bool")]
    return ingest_from_path(spark, path, fields).df


@query_of("execution_filter_map", "SELECT c_custkey,c_acctbal*2 AS c_acctbal FROM customer WHERE c_acctbal<0")
def _(spark, d):
    from strataline.execution import ExecutionEngine

    engine = ExecutionEngine()
    kept = engine.filter_parallel(Dataset(table(spark, d, "customer").select("c_custkey", "c_acctbal")), lambda r: r[1] < 0)
    return engine.map_parallel(kept, lambda r: [r[0], r[1] * 2]).df


@query_of("infer_csv_schema", "SELECT * FROM (VALUES ('o_orderkey','int64'),('o_custkey','int64'),('o_orderstatus','utf8'),('o_totalprice','float64'),('o_orderpriority','utf8')) t(name,data_type)")
def _(spark, d):
    from strataline.sources.readers import infer_schema

    path = scratch_path(spark)
    table(spark, d, "orders").drop("o_orderdate").write.option("header", True).csv(path)
    return spark.createDataFrame([(f["name"], f["data_type"]) for f in infer_schema(spark, path, {"format": "csv"}).to_list()], "name string, data_type string")
