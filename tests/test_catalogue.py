"""Every registered league query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from rinkspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(str(cell(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert _rows(df.collect(), df.columns) == _rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    df = catalogue.flagship(spark, SF)
    assert df.columns == ["c_custkey", "c_name", "c_mktsegment", "c_acctbal", "recreates"] and 0 < df.count() <= 25


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(catalogue.queries()["f09_range_only"](spark, SF))
    assert "GreaterThanOrEqual(p_size,10)" in plan and "LessThanOrEqual(p_retailprice,1000.0)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>" in plan
    page = _plan(catalogue.queries()["l04_search_page"](spark, SF))
    assert "In(c_mktsegment" in page and "TakeOrderedAndProject" in page


def test_first_generation_flags_gather_no_owner_in_one_task(spark):
    plan = _plan(catalogue.queries()["j03_recreate"](spark, SF))
    assert "Window" not in plan and "partial_min" in plan


def test_first_and_last_rows_need_one_shuffle_and_no_join(spark):
    for name in ("j01_latest_value", "j04_most_recent"):
        plan = _plan(catalogue.queries()[name](spark, SF)).split("(1)")[0]
        assert "Join" not in plan and plan.count("Exchange") == 1, name
