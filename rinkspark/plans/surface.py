"""The query surface over league tables that are derived from the given ones: customers are players, orders their earnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark import api
from rinkspark.operators import clusters, merge, rosters, templates
from rinkspark.plans import flows
from rinkspark.plans.registered import Queries
from rinkspark.plans.stats import _BITS, _HAM, _signs
from rinkspark.session import Dataset
from rinkspark.streaming import increments

QUERIES = query = Queries()

# The position codes, dealt to players by their key.
_POSITIONS = (0, 1, 2, 4, 5, 6)
#: Users of the derived tables; each has the players whose key leaves its number.
USERS = 97


class League:
    """Players, users and earnings in the shape that ``api`` reads."""

    def __init__(self, tables: Dataset):
        self.spark, self.given = tables.spark, tables

    @property
    def player_information(self) -> DataFrame:
        key = F.col("c_custkey")
        position = F.array(*map(F.lit, _POSITIONS))[(key % 6).cast("int")]
        born = F.timestamp_micros((key * 7919 % 1009) * 86_400_000_000)
        return self.given.customer.select(key.alias("player_id"), (key % USERS).alias("user_id"), F.col("c_name").alias("name"), F.concat(F.lit("user"), key % USERS).alias("username"), position.alias("position"), (key % 4).cast("int").alias("status"), born.alias("creation_time"), F.floor("c_acctbal").cast("int").alias("total_tpe"), F.floor("c_acctbal").alias("speed"), (key % 100).alias("faceOffs"))

    @property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.given.customer.where(key < USERS).select(key.alias("user_id"), F.concat(F.lit("user"), key).alias("name"), F.concat(F.lit("d"), key * 31).alias("discord_id"))

    @property
    def tpe_events(self) -> DataFrame:
        rows = self.given.orders.select(F.col("o_custkey").alias("player_id"), F.col("o_orderdate").cast("timestamp").alias("task_date"), F.floor("o_totalprice").alias("total_tpe"))
        return rows.groupBy("player_id", "task_date").agg(F.max("total_tpe").alias("total_tpe"))


_PLAYERS = f"""(SELECT c_custkey AS player_id, c_custkey % {USERS} AS user_id, c_name AS name, 'user' || (c_custkey % {USERS}) AS username, [{', '.join(map(str, _POSITIONS))}][1 + c_custkey % 6] AS position,
 (c_custkey * 7919) % 1009 AS born, CAST(floor(c_acctbal) AS INT) AS total_tpe FROM customer)"""
_SHORT = "CASE position WHEN 0 THEN 'G' WHEN 1 THEN 'LD' WHEN 2 THEN 'RD' WHEN 4 THEN 'C' WHEN 5 THEN 'LW' ELSE 'RW' END"


@query("l03_cards", f"SELECT player_id, row_number() OVER (PARTITION BY user_id ORDER BY born, player_id) > 1 AS recreate, {_SHORT} AS position_name FROM {_PLAYERS}")
def cards(t):
    return api.Players(League(t)).cards().select("player_id", "recreate", "position_name")


@query("l07_user_search", f"SELECT c_custkey AS user_id, 'user' || c_custkey AS name FROM customer WHERE c_custkey < {USERS} AND ('user' || c_custkey LIKE '%1%' OR 'd' || c_custkey * 31 LIKE '%1%') ORDER BY name DESC, user_id LIMIT 10 OFFSET 10")
def user_search(t):
    rows, _ = api.Users(League(t)).search("1", private=True, by_discord=True, descending=True, page=2, page_size=10)
    return rows.select("user_id", "name")


@query("l07_user_players", f"SELECT player_id, name AS player FROM {_PLAYERS} WHERE user_id = 7")
def user_players(t):
    return api.Users(League(t)).get("user7").select("player_id", "player")


_COMPARED = [3, 1, 4, 15, 9, 26]


@query("l10_compared_attributes", f"SELECT player_id, n AS name, label, CAST(v AS DOUBLE) AS value FROM (SELECT c_custkey AS player_id, unnest(['speed', 'faceOffs']) AS n, unnest(['Speed', 'Face Offs']) AS label, unnest([CAST(floor(c_acctbal) AS BIGINT), c_custkey % 100]) AS v FROM customer WHERE c_custkey IN ({', '.join(map(str, _COMPARED))}))")
def compared_attributes(t):
    return api.Players(League(t)).compared(_COMPARED, ["speed", "faceOffs"])[1]


_EVENTS = "(SELECT o_custkey AS player_id, CAST(o_orderdate AS TIMESTAMP) AS d, max(CAST(floor(o_totalprice) AS BIGINT)) AS tpe FROM orders GROUP BY ALL)"


@query("l10_compared_timelines", f"""
WITH e AS (SELECT * FROM {_EVENTS} WHERE player_id IN ({', '.join(map(str, _COMPARED))})), f AS (SELECT player_id, min(d) AS first FROM e GROUP BY player_id)
SELECT player_id, CAST(tpe AS BIGINT) AS total_tpe, CAST(epoch_us((SELECT min(first) FROM f) + (d - first)) AS BIGINT) AS at FROM e JOIN f USING (player_id)""")
def compared_timelines(t):
    return api.Players(League(t)).compared(_COMPARED, ["speed"])[2].select("player_id", "total_tpe", F.unix_micros("aligned").alias("at"))


@query("l13_player_summary", f"SELECT {_SHORT} AS position, count(*) AS players, printf('%.1f', sign(avg(total_tpe)) * floor(abs(avg(total_tpe)) * 10 + 0.5) / 10) AS average_tpe FROM {_PLAYERS} GROUP BY position")
def player_summary(t):
    return flows.player_summary(League(t).player_information)


@query("f18_numeric_rows", "SELECT p_partkey, CAST(coalesce(TRY_CAST(a AS FLOAT), -1) AS DOUBLE) AS size, a IS NOT NULL AND TRY_CAST(a AS FLOAT) IS NOT NULL AS numeric FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'n/a' WHEN p_size % 5 > 0 THEN p_size || '.5' END AS a FROM part)")
def numeric_rows(t):
    text = F.when(F.col("p_size") % 7 == 0, "n/a").when(F.col("p_size") % 5 > 0, F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    good, bad = clusters.vectors(t.part.select("p_partkey", text.alias("s.size"), F.lit("1").alias("s.one")), ["s.size", "s.one"])
    left = bad.select("p_partkey", F.lit(-1.0).alias("size"), F.lit(False).alias("numeric"))
    return good.select("p_partkey", F.col("features")[0].cast("double").alias("size"), F.lit(True).alias("numeric")).unionByName(left)


@query("k02_changed_entities", "SELECT o_orderkey, o_custkey % 5 = 0 OR o_orderkey % 9 = 0 AS changed FROM orders")
def changed_entities(t):
    before = F.struct("o_orderstatus", "o_custkey", "o_orderpriority").alias("_t")
    after = F.struct("o_orderstatus", F.when(F.col("o_custkey") % 5 == 0, -1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("o_orderpriority")).alias("_s")
    return t.orders.select("o_orderkey", before, after).select("o_orderkey", merge.differs(["o_orderstatus", "o_custkey", "o_orderpriority"]).alias("changed"))


_LEFT_OUT = f"""
WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, {_BITS} AS b FROM embeddings),
 d AS (SELECT a.vec_id AS ordinal, a.label, t.vec_id AS o, t.label AS l, {_HAM} / 63.0 AS d FROM v a JOIN v t ON a.vec_id <> t.vec_id),
 n AS (SELECT ordinal, label, arg_min(l, (d, o)) AS predicted, min(d) FILTER (WHERE l = label) AS same, min(d) FILTER (WHERE l <> label) AS other FROM d GROUP BY ALL)"""


@query("a22_label_margins", f"{_LEFT_OUT} SELECT label, round(sum(coalesce(other, 0)) / count(*) - avg(same), 6) AS margin, count(*) = 1 AS single FROM n GROUP BY label")
def label_margins(t):
    return templates.evaluation(templates.leave_one_out(_signs(t), 63)).select("label", F.round("margin", 6).alias("margin"), "single")


@query("a22_confusion", f"{_LEFT_OUT} SELECT label, predicted, count(*) AS n FROM n WHERE predicted <> label GROUP BY ALL")
def confusion(t):
    return templates.confusion(templates.leave_one_out(_signs(t), 63))


@query("r05_rows_to_fetch", "SELECT o_orderkey, 'probe stored' AS known FROM orders WHERE o_custkey % 12 IN (10, 11) UNION ALL SELECT o_orderkey, 'probe missing' FROM orders")
def rows_to_fetch(t):
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 12).alias("season"))

    def fetched(stored: DataFrame, known: str) -> DataFrame:
        seasons = increments.seasons_to_fetch(stored, 11)
        return (rows if seasons is None else rows.where(F.col("season").isin(seasons))).select("o_orderkey", F.lit(known).alias("known"))

    return fetched(rows, "probe stored").unionByName(fetched(rows.where("season <> 9"), "probe missing"))


@query("v07_fallback", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS INT) ELSE CAST(o_orderkey % 50 + 7 AS INT) END AS speed FROM orders")
def fallback(t):
    recognised = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string"))
    fields = t.orders.select("o_orderkey", F.lit("attribute").alias("kind"), F.lit("speed").alias("name"), recognised.alias("recognised"), (F.col("o_orderkey") % 50 + 7).cast("string").alias("ocr"))
    return templates.routed(fields, "o_orderkey").select("o_orderkey", F.col("attributes")["speed"].alias("speed"))


@query("j20_player_names", "SELECT c_custkey, a.p_name AS first, b.p_name AS surname, CAST(NULL AS VARCHAR) AS common FROM customer LEFT JOIN part a ON a.p_partkey = c_custkey * 3 LEFT JOIN part b ON b.p_partkey = CASE WHEN c_custkey % 4 > 0 THEN c_nationkey ELSE -1 END")
def player_names(t):
    surname = F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).otherwise(rosters.NOBODY)
    players = t.customer.select("c_custkey", (F.col("c_custkey") * 3).alias("first_id"), surname.alias("surname_id"), F.lit(rosters.NOBODY).alias("common_id"))
    return rosters.resolved(players, {"first_id": "first", "surname_id": "surname", "common_id": "common"}, t.part, "p_partkey", "p_name").select("c_custkey", "first", "surname", "common")


@query("j20_line_slots", """
WITH l AS (SELECT s_suppkey, [s_suppkey, -1, s_suppkey + 1, s_suppkey * 2, 5, -1] AS forwards, [s_nationkey, s_suppkey * 9] AS goalies, [[1, 0, 0, 1, 1], [0]] AS locks FROM supplier),
 u AS (SELECT s_suppkey, 'forwards' AS situation, unnest(forwards) AS identity, unnest(range(6)) AS slot, 3 AS size, locks[1] AS k FROM l UNION ALL SELECT s_suppkey, 'goalies', unnest(goalies), unnest(range(2)), 1, locks[2] FROM l)
SELECT s_suppkey, situation, CAST(slot AS INT) AS slot, CAST(slot // size AS INT) AS unit, CAST(slot % size AS INT) AS place, k[slot + 1] = 1 AS locked, c_name AS player FROM u LEFT JOIN customer ON c_custkey = identity AND identity <> -1""")
def line_slots(t):
    key = F.col("s_suppkey")
    none = F.lit(rosters.NOBODY).cast("long")
    lines = t.supplier.select("s_suppkey", F.array(key, none, key + 1, key * 2, F.lit(5).cast("long"), none).alias("forwards"), F.array(F.col("s_nationkey").cast("long"), key * 9).alias("goalies"), F.lit([[1, 0, 0, 1, 1], [0]]).alias("locks"))
    each = rosters.units(rosters.slots(lines, "s_suppkey", ["forwards", "goalies"], "locks"), {"forwards": 3, "goalies": 1})
    return rosters.resolved(each, {"identity": "player"}, t.customer, "c_custkey", "c_name").drop("identity")
