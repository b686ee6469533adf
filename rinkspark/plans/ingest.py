"""Merge, history, overlap and backfill; events split into stored and incoming rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.operators import latest, merge
from rinkspark.plans.registered import Queries
from rinkspark.streaming import increments, screens

QUERIES = query = Queries()

_STORED = "(SELECT event_id, user_id, value FROM events WHERE event_id % 3 < 2)"
_NEW = "(SELECT event_id, user_id, CASE WHEN event_id % 6 = 1 THEN NULL WHEN event_id % 6 = 4 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 3 >= 1)"


def _stored(t):
    return t.events.where("event_id % 3 < 2").select("event_id", "user_id", "value")


def _new(t):
    changed = F.when(F.col("event_id") % 6 == 1, None).when(F.col("event_id") % 6 == 4, F.col("value") + 1).otherwise(F.col("value"))
    return t.events.where("event_id % 3 >= 1").select("event_id", "user_id", changed.alias("value"))


_MERGED = f"""SELECT coalesce(t.event_id, s.event_id) AS event_id, CASE WHEN s.event_id IS NULL OR (t.event_id IS NOT NULL AND t.value IS NOT DISTINCT FROM s.value AND t.user_id IS NOT DISTINCT FROM s.user_id) THEN t.user_id ELSE s.user_id END AS user_id,
 CASE WHEN s.event_id IS NULL OR (t.event_id IS NOT NULL AND t.value IS NOT DISTINCT FROM s.value AND t.user_id IS NOT DISTINCT FROM s.user_id) THEN t.value ELSE s.value END AS value,
 CASE WHEN t.event_id IS NULL THEN 'inserted' WHEN s.event_id IS NOT NULL AND (t.value IS DISTINCT FROM s.value OR t.user_id IS DISTINCT FROM s.user_id) THEN 'updated' ELSE 'none' END AS change
 FROM {_STORED} t FULL JOIN {_NEW} s ON t.event_id = s.event_id"""


@query("k01_merged", _MERGED)
def merged(t):
    return merge.merged(_stored(t), _new(t), ["event_id"])


@query("k01_changes", f"SELECT change, count(*) AS n FROM ({_MERGED}) GROUP BY change")
def changes(t):
    return merge.changes(merge.merged(_stored(t), _new(t), ["event_id"]))


@query("k03_view_refresh", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def view_refresh(t):
    order = ["o_orderdate", "o_orderkey"]
    old = latest.latest(t.orders.where("o_orderdate < timestamp_ntz'2000-01-01'"), ["o_custkey"], order, ["o_orderkey"])
    return merge.merged(old, latest.latest(t.orders, ["o_custkey"], order, ["o_orderkey"]), ["o_custkey"]).drop("change")


@query("k04_history", f"""
WITH m AS ({_MERGED})
SELECT event_id, value, CASE WHEN change = 'none' THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS valid_from, TIMESTAMP '9999-12-31 00:00:00' AS valid_to FROM m
UNION ALL SELECT s.event_id, s.value, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00' FROM {_STORED} s JOIN m USING (event_id) WHERE change = 'updated'""")
def history(t):
    start, at, end = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:00:00", "2024-02-01 00:00:00", merge.FOREVER))
    current = _stored(t).withColumn("valid_from", start).withColumn("valid_to", end)
    now, old = merge.with_history(current, current.limit(0), merge.merged(_stored(t), _new(t), ["event_id"]), ["event_id"], at)
    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return now.unionByName(old).select("event_id", "value", local("valid_from"), local("valid_to"))


@query("a07_last_wins", "SELECT user_id, d, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS d, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(t):
    return latest.last_wins(t.events.select("user_id", F.to_date("ts").alias("d"), "event_id"), ["user_id", "d"], "event_id")


_OLD = "(SELECT user_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' AND user_id % 10 <> 3)"


def _old(t):
    return t.events.where("ts < timestamp_ntz'2024-01-15 00:00:00' and user_id % 10 <> 3").select("user_id", "ts", "value")


@query("r02_overlap", f"SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, max(ts) - INTERVAL 3 DAY AS cutoff FROM {_OLD} GROUP BY user_id) c USING (user_id) WHERE cutoff IS NULL OR ts >= cutoff")
def overlap(t):
    return increments.overlapping(t.events, _old(t), "user_id", "ts", 3).select("event_id")


@query("r02_overlap_merge", f"""
WITH c AS (SELECT user_id, max(ts) - INTERVAL 3 DAY AS cutoff FROM {_OLD} GROUP BY user_id),
 n AS (SELECT e.user_id, e.ts, e.value - 1 AS value FROM events e LEFT JOIN c USING (user_id) WHERE cutoff IS NULL OR e.ts >= cutoff)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.ts, n.ts) AS ts, coalesce(n.value, o.value) AS value FROM {_OLD} o FULL JOIN n ON o.user_id = n.user_id AND o.ts = n.ts""")
def overlap_merge(t):
    incoming = t.events.select("user_id", "ts", (F.col("value") - 1).alias("value"), F.col("event_id").alias("ordinal"))
    return increments.overlap_merged(_old(t), incoming, "user_id", "ts", "ordinal", 3).drop("change")


@query("r03_backfill_batch", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) ORDER BY c_custkey LIMIT 200")
def backfill_batch(t):
    return increments.backfill_batch(t.customer.select("c_custkey"), t.events.select(F.col("user_id").alias("c_custkey")), "c_custkey")


@query("f12_eligible", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 90 DAY)")
def eligible(t):
    status = F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "F", 3).otherwise(0)
    return t.orders.where(increments.eligible(status, F.col("o_orderdate"), F.expr("timestamp_ntz'2000-06-01'"))).select("o_orderkey")


@query("r06_settled_screens", """
WITH RECURSIVE e AS (SELECT user_id AS source, event_id AS ordinal, CAST(floor(value / 20) AS BIGINT) * 1000003 AS hash, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 s(source, n, ordinal, last, candidate) AS (SELECT DISTINCT source, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM e
  UNION ALL
  SELECT source, n, CASE WHEN NOT old AND sure THEN ordinal END, CASE WHEN NOT old AND sure THEN hash ELSE last END, CASE WHEN old THEN candidate WHEN sure THEN NULL ELSE hash END FROM (
   SELECT e.source, e.n, e.ordinal, e.hash, s.last, s.candidate, coalesce(bit_count(xor(e.hash, s.last)) <= 1, false) AS old, coalesce(bit_count(xor(e.hash, s.candidate)) <= 1, false) AS sure FROM s JOIN e ON e.source = s.source AND e.n = s.n + 1))
SELECT source, ordinal FROM s WHERE ordinal IS NOT NULL""")
def settled_screens(t):
    frames = t.events.select(F.col("user_id").alias("source"), F.col("event_id").alias("ordinal"), (F.floor(F.col("value") / 20) * 1000003).alias("hash"))
    return screens.settled(frames)


@query("r07_stored_once", "SELECT count(*) AS n, count(DISTINCT content_hash) AS hashes FROM (SELECT DISTINCT sha256(text) AS content_hash FROM documents)")
def stored_once(t):
    hashes = t.documents.select(F.sha2("text", 256).alias("content_hash")).dropDuplicates(["content_hash"])
    return hashes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("content_hash").alias("hashes"))


@query("k13_new_captures", "SELECT content_hash, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents) WHERE content_hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0) GROUP BY content_hash")
def new_captures(t):
    from rinkspark.sources.writers import stored_once as once

    hashed = t.documents.select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return once(hashed, hashed.where("doc_id % 5 = 0"), "content_hash", ["doc_id"])


@query("x38_changed_ratings", "SELECT o_orderkey, o_orderkey % 4 = 1 OR o_orderkey % 6 = 5 AS changed FROM orders")
def changed_ratings(t):
    rows = t.orders.select("o_orderkey", F.struct(F.col("o_custkey").alias("speed"), F.when(F.col("o_orderkey") % 4 != 1, F.col("o_totalprice")).alias("shot")).alias("_t"), F.struct((F.col("o_custkey") + F.when(F.col("o_orderkey") % 6 == 5, 1).otherwise(0)).alias("speed"), F.col("o_totalprice").alias("shot")).alias("_s"))
    return rows.select("o_orderkey", merge.differs(["speed", "shot"]).alias("changed"))
