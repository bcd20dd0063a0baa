"""Every query against its SQL on the small tables, and what plans must not hold."""

import decimal
import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

GENERAL = sorted(n for m in entry._MODULES if not m.__name__.startswith("evidra.llm") for n in m.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else str(v)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def compare(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("name", [n for n in GENERAL if n in entry.oracle_sql()])
def test_against_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", [n for n in GENERAL if n not in entry.oracle_sql()])
def test_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", GENERAL)
def test_no_pairs_of_everything(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = entry.queries()["mentions_monthly"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source_id:string,capture_date:bigint,record_date:bigint,carrier:string>" in plan
    assert "PushedFilters: [IsNotNull(carrier)]" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
