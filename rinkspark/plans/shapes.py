"""Export shapes: flattening, column unions, pivots, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.operators import export
from rinkspark.plans.flows import player_summary
from rinkspark.plans.registered import Queries
from rinkspark.sources import writers

QUERIES = query = Queries()


@query("a01_summary", "SELECT CASE p_size % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'LD' ELSE 'RD' END AS position, count(*) AS players, printf('%.1f', avg(CAST(p_partkey AS DOUBLE))) AS average_tpe FROM part GROUP BY ALL")
def summary(t):
    return player_summary(t.part.select(F.expr("cast(p_size % 3 as int)").alias("position"), F.col("p_partkey").alias("total_tpe")))


@query("k06_csv_lines", '''SELECT p_partkey || ',"' || p_name || ', ""' || p_brand || '""",' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS line FROM part''')
def csv_lines(t):
    return writers.csv_lines(t.part.select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("n"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("t")))


@query("k07_flattened", """SELECT p_partkey AS "player.id", p_size AS "player.stats.size", '["' || p_type || '"]' AS tags FROM part""")
def flattened(t):
    nested = t.part.select(F.struct(F.col("p_partkey").alias("id"), F.struct(F.col("p_size").alias("size")).alias("stats")).alias("player"), F.array("p_type").alias("tags"))
    return export.flattened(nested)


@query("k07_seen_columns", "SELECT * FROM (VALUES ('c', 0), ('a', 1)) v(name, place)")
def seen_columns(t):
    rows = t.part.select(F.when(F.col("p_partkey") > 5, 1).alias("a"), F.lit(None).cast("int").alias("b"), F.col("p_size").alias("c"), "p_partkey")
    seen = export.seen_columns(rows, "p_partkey")
    return t.spark.createDataFrame([(c, i) for i, c in enumerate(seen)], "name string, place int")


@query("k08_json_lines", """SELECT '{"p_partkey":' || p_partkey || ',"t":' || CASE WHEN p_size % 2 = 0 THEN '"' || p_type || '"' ELSE 'null' END || '}' AS line FROM part""")
def json_lines(t):
    return writers.json_lines(t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("t")))


@query("p07_dropped_fields", """SELECT p_partkey, '{"name":"' || p_name || '"}' AS s FROM part""")
def dropped_fields(t):
    rows = t.part.select("p_partkey", F.struct(F.col("p_name").alias("name"), F.lit(15).alias("determination"), F.lit(15).alias("leadership")).alias("s"))
    return export.without_fields(rows, "s", ["determination", "leadership"]).select("p_partkey", F.to_json("s").alias("s"))


@query("p11_unpivoted", "SELECT s_suppkey, 's_nationkey' AS name, 'S_nationkey' AS label, CAST(s_nationkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 'acctBal', 'Acct Bal', s_acctbal FROM supplier")
def unpivoted(t):
    rows = t.supplier.withColumnRenamed("s_acctbal", "acctBal")
    return export.unpivoted(rows, ["s_suppkey"], ["s_nationkey", "acctBal", "s_name"], ("s_name",))


@query("p12_grouped_attributes", "SELECT s_suppkey, 'acctBal' AS name, 'Offense' AS category FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', NULL FROM supplier")
def grouped_attributes(t):
    rows = t.supplier.withColumnRenamed("s_acctbal", "acctBal")
    categories = t.spark.createDataFrame([("acctBal", "Offense")], "name string, category string")
    return export.grouped_attributes(export.unpivoted(rows, ["s_suppkey"], ["s_nationkey", "acctBal"]), categories).select("s_suppkey", "name", "category")


@query("p13_page_meta", "SELECT c_name AS title, c_mktsegment || ', ' || format('{:,}', CAST(floor(c_acctbal) AS BIGINT)) || ' TPE' AS description FROM customer")
def page_meta(t):
    return export.page_meta(t.customer.withColumn("tpe", F.floor("c_acctbal")), "c_name", "c_mktsegment", "tpe")


@query("p14_temporal", "SELECT c_custkey, TIMESTAMP '2024-01-01 00:00:00' AS valid_from FROM customer")
def temporal(t):
    from rinkspark.operators.merge import temporal as wrapped

    start = F.expr("timestamp_ntz'2024-01-01'")
    return wrapped(t.customer.withColumn("valid_from", start).withColumn("valid_to", start), ["c_custkey"]).select("item.c_custkey", "valid_from")


@query("u07_column_union", "SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def column_union(t):
    return export.union_columns(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))


@query("k09_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS \"F\", round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS \"O\" FROM lineitem GROUP BY l_returnflag")
def pivot(t):
    by = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return by.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))
