"""Registered queries against their SQL on tables made for a fault."""

import random
import tracemalloc
from datetime import datetime

import duckdb
import numpy as np
import pytest

from rinkspark.operators import templates
from rinkspark.plans import catalogue


def _same(spark, tmp_path, name, **tables):
    """The query's and the SQL's rows over ``tables``, sorted; both as text."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, str(tmp_path)).select(want.columns)
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["x39_id_list", "u06_flattened_ids"])
def test_equal_keys_stay_two_ids(spark, tmp_path, name):
    orders = spark.createDataFrame([(20007, 7), (20007, 8), (5, 20005)], "o_orderkey long, o_custkey long")
    customer = spark.createDataFrame([(1000003, 3), (1000003, 4), (7, 0)], "c_custkey long, c_nationkey int")
    got, want = _same(spark, tmp_path, name, orders=orders, customer=customer)
    assert got == want


def test_seasons_pass_their_fold_as_a_stream(spark, tmp_path):
    rows = [(k, k * 7 % 40, k % 5 if k < 200 else 3, 1 + k % 3, "ANR"[k * k % 3], "FFO"[k % 3], datetime(2020, 1, 1 + k * 11 % 28)) for k in range(400)]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, want = _same(spark, tmp_path, "e05_season_ratings", lineitem=lineitem)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    plan = catalogue.queries()["e05_season_ratings"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan  # those hold a whole season in a Python worker


@pytest.mark.parametrize("name", ["a22_label_margins", "a22_confusion", "v05_leave_one_out"])
def test_leaving_one_out_among_copies(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(templates, "LEAST_BLOCK", 20)
    rng = random.Random(6)
    vectors = [[rng.choice([-1.0, 1.0]) if i % 9 == 0 else 1.0 for i in range(64)] for _ in range(30)]
    rows = [(i, rng.choice(vectors), rng.choice([0, 1, 1, 2]) if i else 9) for i in range(120)]
    got, want = _same(spark, tmp_path, name, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got == want
    plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # that held each row against the whole table


def test_distances_are_held_by_tiles():
    rng = np.random.default_rng(7)
    words, labels = rng.integers(0, 1 << 62, (20_000, 1)), rng.integers(0, 10, 20_000)
    tracemalloc.start()
    templates._best(words[:256], np.arange(256), labels[:256], np.arange(len(words)), words, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * templates.TILE[0] * templates.TILE[1] * 8
