"""What stages of the pipeline ask of the driver, which keeps the plan and statistics of each query."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rinkspark.llm import rows

SF = "/root/testdata/sf0.001"


def _asked(spark, work):
    """The descriptions of the queries that ``work`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    flush = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
    flush()
    before = store.executionsCount()
    work()
    flush()
    every = store.executionsList()
    return [every.apply(i).description() for i in range(before, every.size())]


@pytest.mark.parametrize("stage", ["near_duplicates", "decontamination", "personal_data"])
def test_no_query_of_a_stage_only_counts(spark, stage):
    docs = rows.written(spark.read.parquet(f"{SF}/documents.parquet"))
    asked = _asked(spark, lambda: dict(corpus_pipeline.STAGES)[stage](spark, docs, SF))
    assert asked and not [x for x in asked if not x.startswith(("parquet at", "isEmpty at"))]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_counted_tables_know_their_rows(spark, n):
    table = rows.counted(spark.range(n).select("id", F.lit("né").alias("s")), most=F.max("id"))
    assert table.count() == table._counted["rows"] == n and table._counted["most"] == (n - 1 if n else None)
    assert (table._counted["bytes"] or 0) == n * len('{"s":"né"}'.encode())


def test_a_side_is_broadcast_by_what_was_counted(spark, monkeypatch):
    marked = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    table = rows.counted(spark.range(10).select("id", F.lit("x" * 10).alias("s")))
    part = table.where("id < 2")
    assert marked(rows.small(table)) and marked(rows.small(part, of=table))
    monkeypatch.setattr(rows, "BROADCAST_ROWS", 5)
    assert not marked(rows.small(table)) and marked(rows.small(part, of=table)) and not marked(rows.small(table.select("id"), of=table))
    monkeypatch.setattr(rows, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(rows, "BROADCAST_BYTES", 60)
    assert not marked(rows.small(table)) and marked(rows.small(part, of=table)) and marked(rows.small(table.select("id"), of=table))
