"""Search, lookup, latest rows and league queries; customers and orders stand for users and players."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.operators import latest, league, lookup, search
from rinkspark.plans.registered import Queries

QUERIES = query = Queries()


def _found(t) -> tuple[DataFrame, DataFrame]:
    predicates = [
        search.contains(["c_name", "c_mktsegment"], " 7 "),
        search.one_of("c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD", "BUILDING"]),
        search.between("c_acctbal", 0.0, 9000.0),
        search.equal("c_nationkey", None),
    ]
    return search.search(t.customer, predicates, "c_acctbal", "c_custkey", True, 2, 20)


_FOUND = "FROM customer WHERE (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7')) AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_acctbal BETWEEN 0 AND 9000"


@query("l04_search_page", f"SELECT * {_FOUND} ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def search_page(t):
    return _found(t)[0]


@query("a14_search_total", f"SELECT count(*) AS total {_FOUND}")
def search_total(t):
    return _found(t)[1]


@query("f05_nullable_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END IN ('1-URGENT', '2-HIGH')")
def nullable_in_list(t):
    rows = t.orders.withColumn("maybe", F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")))
    return search.filtered(rows, [search.one_of("maybe", ["1-URGENT", "2-HIGH"])]).select("o_orderkey", "o_orderpriority")


@query("f09_range_only", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_retailprice <= 1000")
def range_only(t):
    return search.filtered(t.part, [search.between("p_size", 10), search.between("p_retailprice", None, 1000)]).select("p_partkey", "p_size")


@query("f10_id_or_name", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42 OR c_name = 'Customer#000000007'")
def id_or_name(t):
    by_id = t.customer.where(search.id_or_name("c_custkey", "c_name", "42"))
    return by_id.union(t.customer.where(search.id_or_name("c_custkey", "c_name", "Customer#000000007"))).select("c_custkey", "c_name")


@query("f11_gated_column", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer WHERE contains(lower(c_name), '99')")
def gated_column(t):
    rows = search.filtered(t.customer, [search.contains(["c_name"], "99")])
    return search.gated(rows, "c_mktsegment", False).select("c_custkey", "c_mktsegment")


@query("f17_any_present", "SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 1 END, CASE WHEN o_orderkey % 3 = 0 THEN 1 END) IS NOT NULL")
def any_present(t):
    from rinkspark.operators.clusters import members

    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 1).alias("s.a"), F.when(F.col("o_orderkey") % 3 == 0, 1).alias("s.b"))
    return members(rows, ["s.a", "s.b"]).select("o_orderkey")


@query("p01_card", "SELECT o_orderkey, c_name, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, -1.0) AS attributes, EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND (e.o_orderdate < o.o_orderdate OR (e.o_orderdate = o.o_orderdate AND e.o_orderkey < o.o_orderkey))) AS recreate FROM orders o JOIN customer ON o_custkey = c_custkey")
def card(t):
    rows = latest.with_recreate(t.orders, "o_custkey", "o_orderdate", "o_orderkey")
    rows = rows.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "c_name", F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")), F.lit(-1.0)).alias("attributes"), "recreate")


@query("p02_suggestions", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def suggestions(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment").orderBy("c_name", "c_custkey")


@query("j01_latest_value", "SELECT user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_value(t):
    return latest.latest(t.events, ["user_id"], ["ts", "event_id"], ["value", "event_type"])


@query("j02_latest_or_default", "SELECT c_custkey, coalesce(o_totalprice, 0.0) AS o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON c_custkey = o_custkey")
def latest_or_default(t):
    last = latest.latest(t.orders.where("o_orderstatus = 'P'"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"]).withColumnRenamed("o_custkey", "c_custkey")
    return latest.with_value(t.customer.select("c_custkey"), last, ["c_custkey"], "o_totalprice", 0.0)


@query("j03_recreate", "SELECT o_orderkey, EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND (e.o_orderdate < o.o_orderdate OR (e.o_orderdate = o.o_orderdate AND e.o_orderkey < o.o_orderkey))) AS recreate FROM orders o")
def recreate(t):
    return latest.with_recreate(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "recreate")


@query("j04_most_recent", "SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND (e.o_orderdate > o.o_orderdate OR (e.o_orderdate = o.o_orderdate AND e.o_orderkey > o.o_orderkey)))")
def most_recent(t):
    return latest.latest(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@query("j08_navigation", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def navigation(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("j09_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def semi_join(t):
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.already(t.orders, rich, ["o_custkey"]).select("o_orderkey")


@query("j10_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')")
def anti_join(t):
    done = t.orders.where("o_orderdate >= timestamp_ntz'2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.missing(t.customer.select("c_custkey"), done, ["c_custkey"])


@query("j13_owner_rows", "SELECT c_custkey, c_name, o_orderkey, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey BETWEEN 10 AND 20")
def owner_rows(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).where("c_custkey between 10 and 20").select("c_custkey", "c_name", "o_orderkey", "o_orderdate")


@query("j14_scalar_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS finished FROM customer")
def scalar_counts(t):
    from rinkspark.operators.ranklist import counts

    owned = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return counts(counts(t.customer.select("c_custkey"), owned, "c_custkey", "orders"), owned.where("o_orderstatus = 'F'"), "c_custkey", "finished")


_GAMES = "SELECT CAST(o_orderkey AS BIGINT) AS game, CAST(0 AS INT) AS league_id, CAST(1 AS INT) AS season, CAST(o_custkey % 25 AS INT) AS home_team_id, CAST((o_custkey + 1 + o_orderkey % 24) % 25 AS INT) AS away_team_id FROM orders"


@query("j17_two_teams", f"SELECT game, h.n_name AS home_team, a.n_name AS away_team FROM ({_GAMES}) JOIN nation h ON home_team_id = h.n_nationkey JOIN nation a ON away_team_id = a.n_nationkey")
def two_teams(t):
    games = t.orders.select(F.col("o_orderkey").alias("game"), F.lit(0).alias("league_id"), F.lit(1).alias("season"), F.expr("cast(o_custkey % 25 as int)").alias("home_team_id"), F.expr("cast((o_custkey + 1 + o_orderkey % 24) % 25 as int)").alias("away_team_id"))
    teams = t.nation.select(F.lit(0).alias("league_id"), F.lit(1).alias("season"), F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"))
    return league.games_with_teams(games, teams).select("game", "home_team", "away_team")


def _seasons(t):
    return t.orders.select(F.expr("cast(o_custkey % 4 as int)").alias("league_id"), F.year("o_orderdate").alias("season")).where("league_id < 3 or season < 1999")


_SEASONS = "(SELECT CAST(o_custkey % 4 AS INT) AS league_id, CAST(year(o_orderdate) AS INT) AS season FROM orders WHERE o_custkey % 4 < 3 OR year(o_orderdate) < 1999)"


@query("l05_seasons", f"SELECT league_id, array_to_string(list_reverse_sort(list(DISTINCT season)), ',') AS seasons FROM {_SEASONS} GROUP BY league_id")
def seasons(t):
    return league.seasons(_seasons(t)).select("league_id", F.array_join(F.col("seasons").cast("array<string>"), ",").alias("seasons"))


@query("a13_current_season", f"SELECT league_id, max(season) AS season FROM {_SEASONS} GROUP BY league_id")
def current_season(t):
    return league.current_seasons(_seasons(t))


@query("t08_team_card", "SELECT n_name AS abbreviation, 'R' || n_regionkey AS league, CAST(2000 + n_nationkey AS INT) AS season FROM nation WHERE lower(n_name) = 'nation_7'")
def team_card(t):
    rows = t.nation.select(F.col("n_name").alias("abbreviation"), F.concat(F.lit("R"), "n_regionkey").alias("league"), (F.col("n_nationkey") + 2000).alias("season"), F.col("n_nationkey").alias("team_id"))
    older = rows.withColumn("season", F.col("season") - 10)
    return league.team_card(rows.union(older), "r2", "Nation_7").select("abbreviation", "league", "season")


@query("t10_autocomplete", "SELECT p_partkey, CAST(CASE WHEN strpos(lower(p_name), 'b') = 1 THEN 0 WHEN strpos(lower(p_brand), 'b') = 1 THEN 1 WHEN strpos(lower(p_name), 'b') > 0 THEN 2 ELSE 3 END AS INT) AS match_rank FROM part WHERE strpos(lower(p_name), 'b') > 0 OR strpos(lower(p_brand), 'b') > 0 ORDER BY match_rank, lower(p_name), p_partkey LIMIT 40")
def autocomplete(t):
    return search.autocomplete(t.part, " B ", 40, "p_name", "p_brand", "p_partkey").select("p_partkey", "match_rank")


@query("t11_user_autocomplete", "SELECT c_custkey, CAST(CASE WHEN strpos(lower(c_name), '00') = 1 THEN 0 ELSE 1 END AS INT) AS match_rank FROM customer WHERE strpos(lower(c_name), '00') > 0 ORDER BY match_rank, lower(c_name), c_custkey LIMIT 15")
def user_autocomplete(t):
    return search.autocomplete(t.customer, "00", 15, "c_name", None, "c_custkey").select("c_custkey", "match_rank")


@query("t01_sorted_page", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END ASC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 2950")
def sorted_page(t):
    key = F.when(F.col("o_custkey") % 5 == 0, None).otherwise(F.col("o_orderpriority"))
    return search.ordered(t.orders, key, False, "o_orderkey").offset(2950).limit(100).select("o_orderkey", "o_orderpriority")


_WANTED_IDS, _WANTED_NAMES = [5, 99999999, 7, 5], ["customer#000000003", " CUSTOMER#000000009 ", "nobody", ""]


@query("l01_resolve", """
WITH w(ordinal, id, name) AS (VALUES (0, 5, NULL), (1, 99999999, NULL), (2, 7, NULL), (3, NULL, 'customer#000000003'), (4, NULL, 'CUSTOMER#000000009'), (5, NULL, 'nobody'))
SELECT CAST(ordinal AS INT) AS ordinal, CASE count(c_custkey) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome, min(c_custkey) AS first_id
FROM w LEFT JOIN customer ON c_custkey = id OR lower(c_name) = lower(name) GROUP BY ordinal""")
def resolve(t):
    wanted = lookup.requests(t.spark, _WANTED_IDS, _WANTED_NAMES)
    return lookup.resolve(wanted, t.customer, "c_custkey", "c_name").select("ordinal", "outcome", F.array_min("ids").alias("first_id"))


@query("l01_ambiguous", "SELECT p_name AS name, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, count(*) AS n FROM part WHERE p_name IN ('red widget', 'blue bolt') GROUP BY p_name")
def ambiguous(t):
    wanted = lookup.requests(t.spark, [], ["Red Widget", "BLUE bolt"])
    return lookup.resolve(wanted, t.part, "p_partkey", "p_name").select(F.lower("name").alias("name"), "outcome", F.size("ids").cast("long").alias("n"))


@query("l02_by_ids", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 1, 999999999, 2)")
def by_ids(t):
    return lookup.by_ids(t.customer, "c_custkey", [3, 1, 3, 999999999, 2], ["c_name"]).select("c_custkey", "c_name")


@query("u02_union_first_seen", "SELECT k FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def union_first_seen(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    return lookup.union_first_seen(rows.where("o_orderstatus = 'F'"), rows.where("o_orderpriority = '1-URGENT'"), "k", "o_orderkey")


@query("u04_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def difference(t):
    return lookup.missing(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("u05_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersection(t):
    return lookup.already(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("w05_counter", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS games_played FROM orders")
def counter(t):
    return latest.counter(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "games_played")


@query("w06_intervals", "SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events")
def intervals(t):
    return latest.intervals(t.events, ["user_id"], "ts").select("event_id", "until")


@query("w06_value_at", "SELECT user_id, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY user_id")
def value_at(t):
    return latest.value_at(t.events, ["user_id"], "ts", F.expr("timestamp_ntz'2024-01-10 00:00:00'")).select("user_id", "value")


@query("w07_aligned", "SELECT event_id, to_microseconds(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) + min(ts) OVER () AS aligned FROM events")
def aligned(t):
    return latest.aligned(t.events, ["user_id"], "ts").select("event_id", "aligned")


@query("a05_arg_max", "SELECT c_mktsegment, arg_max(c_name, (c_acctbal, -c_custkey)) AS c_name FROM customer GROUP BY c_mktsegment")
def arg_max(t):
    rows = t.customer.withColumn("first", -F.col("c_custkey"))
    return latest.latest(rows, ["c_mktsegment"], ["c_acctbal", "first"], ["c_name"])


@query("a06_arg_min_and_sum", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY o_custkey")
def arg_min_and_sum(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.sum(F.floor("o_totalprice")).alias("total"))


@query("a15_any", "SELECT n_nationkey, coalesce(bool_or(c_acctbal > 9900), false) AS rich FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def any_rich(t):
    rich = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.bool_or(F.col("c_acctbal") > 9900).alias("rich"))
    return latest.with_value(t.nation.select("n_nationkey"), rich, ["n_nationkey"], "rich", False)


@query("a23_name_ids", "SELECT lower(p_name) AS name, count(DISTINCT p_partkey) AS ids, min(p_partkey) AS first_id FROM part GROUP BY lower(p_name)")
def name_ids(t):
    ids = t.part.groupBy(F.lower("p_name").alias("name")).agg(F.collect_set("p_partkey").alias("s"))
    return ids.select("name", F.size("s").cast("long").alias("ids"), F.array_min("s").alias("first_id"))
