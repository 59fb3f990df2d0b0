import importlib

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_queries_and_sql_have_the_same_names():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (1, 2, 4, 5, 6, 7):
        assert f"p{n}_found" in entry.queries()


@pytest.mark.parametrize("name", ["flagship", "p1_found", "p3_percentiles", "p4_profiles", "join_full", "profile_full"])
def test_against_sql(spark, name):
    from pathlib import Path

    if not Path(SF).exists():
        pytest.skip("no test data")
    entry = importlib.import_module("__spark_entry__")
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create table {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.5g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[k]) for k in cols) for r in df.collect())
    want = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert sorted(tuple(show(r[names.index(k)]) for k in cols) for r in want.fetchall()) == got
