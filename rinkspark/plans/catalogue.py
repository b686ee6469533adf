"""The registered queries over the driver's tables, each with the SQL that DuckDB can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.operators import latest, search
from rinkspark.plans import boards, ingest, league_queries, more_queries, parsers, recruiting, shapes, stats, surface
from rinkspark.plans.registered import Queries

_PARTS = (league_queries, more_queries, boards, ingest, parsers, recruiting, shapes, stats, surface)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of customers by balance with their orders' first-generation flags counted."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    flags = latest.with_recreate(read("orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")
    counted = flags.groupBy("o_custkey").agg(F.sum(F.col("recreate").cast("long")).alias("recreates"))
    rows, _ = search.search(read("customer"), [search.contains(["c_name"], "customer"), search.between("c_acctbal", 0)], "c_acctbal", "c_custkey", True)
    return rows.join(counted, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.coalesce("recreates", F.lit(0)).alias("recreates"))


def _all() -> Queries:
    out = Queries()
    for part in _PARTS:
        out.take(part.QUERIES)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all().made


def oracle_sql() -> dict[str, str]:
    return _all().sql
