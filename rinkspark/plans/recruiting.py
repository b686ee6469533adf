"""Recruitment over customers: each one's recruiter is made from its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.operators import lineage, recruitment
from rinkspark.plans.registered import Queries
from rinkspark.session import checkpoints
from rinkspark.sources import writers

QUERIES = query = Queries()

_RECRUITER = "CASE WHEN c_custkey % 11 = 0 THEN '  MYSELF ' WHEN c_custkey % 7 = 0 THEN ' Google ' WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey = 5 THEN 'customer#000000018' ELSE 'cUSTOMER#' || lpad(CAST(floor(c_custkey / 3) AS {text}), 9, '0') END"
_USERS = f"(SELECT c_custkey AS user_id, c_name AS username, {_RECRUITER.format(text='INT')} AS recruiter, CAST(floor(c_acctbal) AS BIGINT) AS career_tpe FROM customer)"
_USERS = _USERS.replace("CAST(floor(c_custkey / 3) AS INT)", "CAST(CAST(floor(c_custkey / 3) AS INT) AS VARCHAR)")
_EDGES = f"""(SELECT u.*, CAST(CASE WHEN trim(coalesce(recruiter, '')) = '' THEN 3 WHEN m.c_name IS NOT NULL THEN 0 WHEN lower(trim(recruiter)) = 'myself' THEN 2 ELSE 1 END AS INT) AS category,
 CASE WHEN trim(coalesce(recruiter, '')) = '' THEN '' WHEN m.c_name IS NOT NULL THEN m.c_name WHEN lower(trim(recruiter)) = 'myself' THEN 'Myself' ELSE trim(recruiter) END AS recruiter_key
 FROM {_USERS} u LEFT JOIN customer m ON lower(m.c_name) = lower(trim(recruiter)))"""


def _edges(t):
    recruiter = F.expr(_RECRUITER.format(text="STRING").replace("floor(c_custkey / 3)", "(c_custkey div 3)"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), recruiter.alias("recruiter"), F.floor("c_acctbal").alias("career_tpe"))
    members = t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("ordinal"))
    return recruitment.classified(users, members)


@query("x16_classified", f"SELECT user_id, category, recruiter_key FROM {_EDGES}")
def classified(t):
    return _edges(t).select("user_id", "category", "recruiter_key")


@query("a06_consolidated", "SELECT o_custkey AS user_id, arg_min(CAST(o_orderkey AS VARCHAR), (o_orderdate, o_orderkey)) AS username, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS recruiter, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS career_tpe FROM orders GROUP BY o_custkey")
def consolidated(t):
    rows = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("player_id"), F.col("o_orderkey").cast("string").alias("username"), F.col("o_orderpriority").alias("recruiter"), F.col("o_orderdate").alias("creation_time"), F.floor("o_totalprice").alias("latest_tpe"))
    return recruitment.consolidated(rows)


@query("a08_tallies", f"SELECT category, recruiter_key, count(*) AS users, CAST(sum(career_tpe) AS BIGINT) AS tpe FROM {_EDGES} GROUP BY ALL")
def tallies(t):
    return recruitment.tallies(_edges(t))


@query("a10_summary", f"SELECT category, count(DISTINCT recruiter_key) AS recruiters, count(*) AS users, CAST(sum(career_tpe) AS BIGINT) AS tpe FROM {_EDGES} GROUP BY category")
def summary(t):
    return recruitment.summary(recruitment.tallies(_edges(t)))


_REACH = f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}),
 r(category, recruiter_key, user_id, username) AS (SELECT category, recruiter_key, user_id, username FROM e
 UNION SELECT r.category, r.recruiter_key, e.user_id, e.username FROM r JOIN e ON e.category = 0 AND lower(e.recruiter_key) = lower(r.username))"""


@query("a09_lineage", f"{_REACH} SELECT r.category, r.recruiter_key, count(*) AS lineage_users, CAST(sum(career_tpe) AS BIGINT) AS lineage_tpe FROM r JOIN (SELECT user_id, career_tpe FROM e) USING (user_id) GROUP BY ALL")
def lineage_totals(t):
    edges = _checkpointed(_edges(t))
    return recruitment.tallies(edges, lineage.totals(edges)).select("category", "recruiter_key", "lineage_users", "lineage_tpe")


def _checkpointed(df):
    """Lineage rounds read their edges again and again; they are cut off in the shared folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


@query("j07_tree", f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}),
 t(user_id, username, career_tpe, parent_id, depth, path) AS (SELECT user_id, username, career_tpe, CAST(NULL AS BIGINT), CAST(1 AS INT), [user_id] FROM e WHERE recruiter_key = 'Google'
 UNION ALL SELECT e.user_id, e.username, e.career_tpe, t.user_id, CAST(t.depth + 1 AS INT), list_append(t.path, e.user_id) FROM t JOIN e ON e.category = 0 AND lower(e.recruiter_key) = lower(t.username) WHERE t.depth < 4),
 s AS (SELECT unnest(path) AS user_id, career_tpe FROM t)
SELECT user_id, parent_id, depth, count(*) AS subtree_users, CAST(sum(s.career_tpe) AS BIGINT) AS subtree_tpe FROM t JOIN s USING (user_id) GROUP BY ALL""")
def tree(t):
    edges = _checkpointed(_edges(t))
    return recruitment.tree(edges, "GOOGLE", 4).select("user_id", "parent_id", "depth", "subtree_users", "subtree_tpe")


def _nested(depth: int) -> str:
    """SQL of one recruiter's lineage as a JSON document, so many levels deep."""
    doc = """'{"userId":' || coalesce(CAST(user_id AS VARCHAR), 'null') || ',"name":"' || username || '","category":' || category || ',"careerTpe":' || career_tpe || ',"subtreeUsers":' || users || ',"subtreeCareerTpe":' || tpe || ',"recruited":[' || inside || ']}'"""
    levels = ["l1 AS (SELECT *, CAST(NULL AS BIGINT) AS parent_id FROM e WHERE recruiter_key = 'Google')"]
    levels += [f"l{d} AS (SELECT e.*, l{d - 1}.user_id AS parent_id FROM l{d - 1} JOIN e ON e.category = 0 AND lower(e.recruiter_key) = lower(l{d - 1}.username))" for d in range(2, depth + 1)]
    levels += ["l0 AS (SELECT CAST(NULL AS BIGINT) AS user_id, 'Google' AS username, 1 AS category, 0 AS career_tpe, CAST(NULL AS BIGINT) AS parent_id)", f"n{depth} AS (SELECT *, 0 AS users, 0 AS tpe, '' AS inside FROM l{depth})"]
    for d in range(depth, 0, -1):
        levels += [f"i{d} AS (SELECT parent_id AS p, string_agg({doc}, ',' ORDER BY career_tpe DESC, lower(username), user_id) AS inside, sum(users + 1) AS users, sum(tpe + career_tpe) AS tpe FROM n{d} GROUP BY parent_id)"]
        levels += [f"n{d - 1} AS (SELECT l{d - 1}.*, coalesce(users, 0) AS users, coalesce(tpe, 0) AS tpe, coalesce(inside, '') AS inside FROM l{d - 1} LEFT JOIN i{d} ON l{d - 1}.user_id IS NOT DISTINCT FROM i{d}.p)"]
    return f"WITH e AS (SELECT * FROM {_EDGES}), {', '.join(levels)} SELECT username AS recruiter_key, CAST(category AS INT) AS category, {doc} AS document FROM n0"


@query("p08_nested_lineage", _nested(5))
def nested_lineage(t):
    return lineage.document(_checkpointed(_edges(t)), "gooGLE", 5)


@query("t05_recruiters", f"SELECT * FROM (SELECT category, recruiter_key, count(*) AS users, CAST(sum(career_tpe) AS BIGINT) AS tpe FROM {_EDGES} GROUP BY ALL) ORDER BY tpe DESC, lower(recruiter_key), category LIMIT 25")
def recruiters(t):
    return recruitment.in_order(recruitment.tallies(_edges(t)), "tpe", 25)


@query("f19_addressable", f"SELECT category, recruiter_key, count(*) AS users FROM {_EDGES} WHERE category IN (0, 1) AND lower(recruiter_key) = 'google' GROUP BY ALL")
def addressable(t):
    return recruitment.addressable(recruitment.tallies(_edges(t)), "gOOGLE").select("category", "recruiter_key", "users")


@query("k11_dot_lines", f"""
SELECT 'digraph recruitment {{' AS line UNION ALL SELECT '}}' UNION ALL
SELECT '  "' || n || '";' FROM (SELECT recruiter_key AS n FROM {_EDGES} UNION SELECT username FROM {_EDGES}) UNION ALL
SELECT '  "' || recruiter_key || '" -> "' || username || '" [label="' || career_tpe || '"];' FROM {_EDGES}""")
def dot_lines(t):
    return writers.dot_graph(_edges(t)).select("line")


@query("k12_chart_data", f"SELECT * FROM (SELECT category, recruiter_key, count(*) AS users, CAST(sum(career_tpe) AS BIGINT) AS tpe FROM {_EDGES} WHERE category <> 3 GROUP BY ALL) ORDER BY users DESC, lower(recruiter_key), category LIMIT 20")
def chart_data(t):
    return writers.chart_data(recruitment.tallies(_edges(t)))["users"]


@query("t06_edge_order", f"SELECT recruiter_key, user_id, row_number() OVER (PARTITION BY category, recruiter_key ORDER BY career_tpe DESC, lower(username), user_id) AS place FROM {_EDGES}")
def edge_order(t):
    from pyspark.sql import Window

    by = Window.partitionBy("category", "recruiter_key").orderBy(F.col("career_tpe").desc(), F.lower("username"), "user_id")
    return _edges(t).select("recruiter_key", "user_id", F.row_number().over(by).cast("long").alias("place"))
