"""Board algebra; a customer's orders stand for the entries of a board."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.operators import latest, lookup, ranklist
from rinkspark.plans.registered import Queries

QUERIES = query = Queries()

_E = """(SELECT o_custkey AS board_id, o_orderkey AS player_id, CASE WHEN o_orderstatus = 'F' THEN 'Rejected' ELSE 'Pending' END AS status,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) END AS INT) AS rank FROM orders)"""


def entries(t):
    rejected = F.col("o_orderstatus") == "F"
    rows = t.orders.withColumn("r", rejected).withColumn("n", latest.nth_of(["o_custkey", "r"], ["o_orderdate", "o_orderkey"]))
    return rows.select(F.col("o_custkey").alias("board_id"), F.col("o_orderkey").alias("player_id"), F.when(F.col("r"), "Rejected").otherwise("Pending").alias("status"), F.when(F.col("r"), 0).otherwise(F.col("n")).cast("int").alias("rank"))


_OUT = "board_id, player_id, status, rank"
_DENSE = "CAST(CASE WHEN status = 'Rejected' THEN 0 ELSE row_number() OVER (PARTITION BY board_id, status = 'Rejected' ORDER BY CASE WHEN rank > 0 THEN 0 ELSE 1 END, rank, player_id) END AS INT) AS rank"


@query("w03_compacted", f"SELECT board_id, player_id, status, {_DENSE} FROM {_E} WHERE player_id % 4 <> 0")
def compacted(t):
    return ranklist.compacted(entries(t).where("player_id % 4 <> 0")).select(*_OUT.split(", "))


@query("w04_appended", f"""
WITH e AS (SELECT * FROM {_E}), k AS (SELECT * FROM e WHERE player_id % 3 <> 0), n AS (SELECT board_id, player_id FROM e WHERE player_id % 3 = 0)
SELECT {_OUT} FROM k UNION ALL
SELECT board_id, player_id, 'Pending', CAST(coalesce((SELECT max(rank) FROM k WHERE k.board_id = n.board_id), 0) + row_number() OVER (PARTITION BY board_id ORDER BY player_id) AS INT) FROM n""")
def appended(t):
    e = entries(t)
    new = e.where("player_id % 3 = 0").select("board_id", "player_id", F.col("player_id").alias("ordinal"))
    return ranklist.appended(e.where("player_id % 3 <> 0"), new.union(e.where("player_id % 3 = 1").select("board_id", "player_id", F.lit(0))), "board_id", "player_id").select(*_OUT.split(", "))


@query("b01_added", f"SELECT {_OUT} FROM {_E} WHERE board_id = 7 UNION ALL SELECT 7, 99999999, 'Pending', CAST(coalesce(max(rank), 0) + 1 AS INT) FROM {_E} WHERE board_id = 7")
def added(t):
    return ranklist.added(entries(t).where("board_id = 7"), 7, 99999999).select(*_OUT.split(", "))


@query("b02_bulk_report", """
SELECT 'already' AS outcome, count(*) AS n FROM orders WHERE o_custkey = 7 AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 2)
UNION ALL SELECT 'added', 1 UNION ALL SELECT 'not_found', 2""")
def bulk_report(t):
    e = entries(t).where("board_id = 7")
    there = [r.player_id for r in e.orderBy("player_id").limit(2).collect()]  # two ids of one board
    players = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("name"))
    other = players.join(e.select(F.col("player_id").alias("id")), "id", "left_anti").orderBy("id").first()
    wanted = lookup.requests(t.spark, [*there, -1], [other.name.upper(), "nobody"])
    _, report = ranklist.bulk_added(e, 7, wanted, players, "id", "name")
    return report.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("b03_removed", f"SELECT board_id, player_id, status, {_DENSE} FROM (SELECT * FROM {_E} WHERE NOT (player_id % 5 = 0 AND board_id % 2 = 0))")
def removed(t):
    e = entries(t)
    return ranklist.removed(e, e.where("player_id % 5 = 0 and board_id % 2 = 0")).select(*_OUT.split(", "))


@query("b05_moved", f"SELECT board_id, player_id, status, CAST(CASE WHEN status = 'Rejected' THEN rank WHEN rank = 1 THEN 3 WHEN rank BETWEEN 2 AND 3 THEN rank - 1 ELSE rank END AS INT) AS rank FROM {_E} WHERE board_id = 13")
def moved(t):
    return ranklist.moved(entries(t).where("board_id = 13"), 13, 1, 3).select(*_OUT.split(", "))


@query("b08_moved_within", f"SELECT board_id, player_id, status, CAST(CASE WHEN status = 'Rejected' THEN 0 WHEN rank = 2 THEN (SELECT max(rank) FROM {_E} WHERE board_id = 13) WHEN rank > 2 THEN rank - 1 ELSE rank END AS INT) AS rank FROM {_E} WHERE board_id = 13")
def moved_within(t):
    e = entries(t).where("board_id = 13")
    second = e.where("rank = 2").first().player_id
    return ranklist.moved_within(e, 13, second, 1000).select(*_OUT.split(", "))


@query("b07_bulk_updated", f"""
SELECT board_id, player_id, status, {_DENSE} FROM (
  SELECT board_id, player_id, CASE WHEN player_id % 6 = 0 THEN 'Rejected' WHEN player_id % 6 = 1 THEN 'Shortlisted' ELSE status END AS status,
    CASE WHEN player_id % 6 = 0 THEN 0 ELSE rank END AS rank FROM {_E})""")
def bulk_updated(t):
    e = entries(t)
    change = F.when(F.col("player_id") % 6 == 0, "Rejected").otherwise("Shortlisted")
    changes = e.where("player_id % 6 < 2").select("board_id", "player_id", change.alias("status"), F.lit(None).cast("string").alias("assigned_to"))
    return ranklist.updated(e, changes).select(*_OUT.split(", "))


@query("a16_top_rank", f"SELECT board_id, coalesce(max(rank), 0) AS top FROM {_E} GROUP BY board_id")
def top_rank(t):
    return entries(t).groupBy("board_id").agg(F.coalesce(F.max("rank"), F.lit(0)).alias("top"))


@query("a18_sole_owner", "SELECT c_nationkey AS team_id, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') = 1 AS sole_owner FROM customer GROUP BY c_nationkey")
def sole_owner(t):
    members = t.customer.select(F.col("c_nationkey").alias("team_id"), F.when(F.col("c_mktsegment") == "BUILDING", "Owner").otherwise("Editor").alias("role"))
    return ranklist.sole_owner(members)


@query("b11_capabilities", "SELECT c_custkey, true AS can_view, c_mktsegment IN ('BUILDING', 'MACHINERY') AS can_edit, c_mktsegment = 'BUILDING' AS can_manage FROM customer")
def capabilities(t):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "Owner").when(F.col("c_mktsegment") == "MACHINERY", "Editor").otherwise("Viewer")
    return ranklist.capabilities(t.customer.select("c_custkey", role.alias("role"))).drop("role")


@query("f21_thread", "SELECT event_id FROM events WHERE user_id = 5 AND event_type = 'view' UNION ALL SELECT event_id FROM events WHERE user_id IS NULL")
def thread(t):
    rows = t.events.select("event_id", F.when(F.col("event_type") == "view", F.col("user_id")).alias("entry_id"))
    return ranklist.thread(rows, 5).select("event_id")


@query("f22_view", f"SELECT board_id, player_id FROM {_E} WHERE status <> 'Rejected' AND board_id IN (1, 2, 3) AND contains(lower('P' || player_id), 'p1')")
def view(t):
    e = entries(t).withColumn("name", F.concat(F.lit("P"), "player_id"))
    return ranklist.view(e, "P1", [1, 2, 3], "name", "board_id").select("board_id", "player_id")


@query("t13_member_order", "SELECT c_custkey FROM customer ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END DESC, lower(c_name), c_custkey")
def member_order(t):
    level = F.when(F.col("c_mktsegment") == "BUILDING", 2).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0)
    return t.customer.orderBy(level.desc(), F.lower("c_name"), "c_custkey").select("c_custkey")
