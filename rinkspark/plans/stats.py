"""Stat vectors, clusters, templates and ratings; embeddings stand for players' attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.functions import vectors
from rinkspark.operators import clusters, rating, templates
from rinkspark.plans.registered import Queries

QUERIES = query = Queries()


@query("a21_norms", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS l1, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS l2 FROM embeddings")
def norms(t):
    v = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(vectors.l1_norm(v), 6).alias("l1"), F.round(vectors.l2_norm(v), 6).alias("l2"))


@query("x17_normalised", "SELECT vec_id, round(embedding[1] / list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS first, CAST(1.0 AS DOUBLE) AS total FROM embeddings")
def normalised(t):
    rows = t.embeddings.select("vec_id", vectors.normalised(F.col("embedding"), "l1").alias("n"))
    return rows.select("vec_id", F.round(F.col("n")[0], 6).alias("first"), F.round(vectors.l1_norm(F.col("n")), 6).alias("total"))


_MEAN = "SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS c FROM embeddings, range(1, 65) r(i) GROUP BY label, i"


@query("a20_medoids", f"""
WITH m AS ({_MEAN}), d AS (SELECT label, vec_id, sum(pow(CAST(embedding[i] AS DOUBLE) - CAST(CAST(c AS FLOAT) AS DOUBLE), 2)) AS d FROM embeddings JOIN m USING (label) GROUP BY label, vec_id)
SELECT label AS cluster, count(*) AS members, arg_min(vec_id, (round(d, 9), vec_id)) AS medoid, round(min(d), 3) AS distance FROM d GROUP BY label""")
def medoids(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").alias("features"), F.col("label").alias("cluster"))
    return clusters.medoids(rows, 64, "vec_id").select("cluster", "members", "medoid", F.round("distance", 3).alias("distance"))


@query("a19_centroid", "SELECT round(avg(CAST(embedding[1] AS DOUBLE)), 5) AS first, round(avg(CAST(embedding[64] AS DOUBLE)), 5) AS last, count(*) AS members FROM embeddings")
def centroid(t):
    rows = t.embeddings.select(F.col("embedding").alias("features"), F.lit(1).alias("cluster"))
    return clusters.centroids(rows, 64).select(F.round(F.col("centroid")[0].cast("double"), 5).alias("first"), F.round(F.col("centroid")[63].cast("double"), 5).alias("last"), "members")


_NEAREST = "list_sort(list_transform(range(1, 6), lambda j: {'d': CAST(list_sum(list_transform(range(1, 65), lambda i: (g[i] - c[j][i]) * (g[i] - c[j][i]))) AS BIGINT), 'j': j}))[1].j"


@query("l12_kmeans", f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 65536) AS BIGINT)) AS g FROM embeddings),
 s(n, c) AS (SELECT 0, list(g ORDER BY h, vec_id) FROM (SELECT g, vec_id, md5(vec_id || ':7') AS h FROM v ORDER BY h, vec_id LIMIT 5)
  UNION ALL
  SELECT n + 1, (SELECT list(coalesce(m.g, s.c[k.j]) ORDER BY k.j) FROM range(1, 6) k(j) LEFT JOIN (
    SELECT j, list(CAST((t - ((t % w) + w) % w) // w AS BIGINT) ORDER BY i) AS g FROM (
      SELECT j, i, sum(x) AS t, count(*) AS w FROM (SELECT j, unnest(g) AS x, unnest(range(1, 65)) AS i FROM (SELECT g, {_NEAREST} AS j FROM v, (SELECT s.c AS c))) GROUP BY j, i) GROUP BY j) m ON m.j = k.j) FROM s WHERE n < 6),
 a AS (SELECT vec_id, embedding, {_NEAREST} AS cluster FROM v, (SELECT c FROM s WHERE n = 6)),
 m AS (SELECT cluster, i, CAST(avg(CAST(embedding[i] AS DOUBLE)) AS FLOAT) AS x FROM a, range(1, 65) r(i) GROUP BY cluster, i),
 d AS (SELECT cluster, vec_id, sum(pow(CAST(embedding[i] - x AS DOUBLE), 2)) AS d FROM a JOIN m USING (cluster) GROUP BY cluster, vec_id)
SELECT CAST(cluster AS INT) AS cluster, count(*) AS members, arg_min(vec_id, (round(d, 9), vec_id)) AS medoid FROM d GROUP BY cluster""")
def kmeans(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").alias("features"))
    return clusters.medoids(clusters.lloyd(rows, 5, "vec_id", 7, rounds=6), 64, "vec_id", 5).select("cluster", "members", "medoid")


_BITS = "list_transform(list_slice(embedding, 1, 63), lambda x: x > 0)"
_HAM = "list_sum(list_transform(range(1, 64), lambda i: CASE WHEN a.b[i] <> t.b[i] THEN 1 ELSE 0 END))"


def _signs(t):
    return t.embeddings.select(F.col("vec_id").alias("ordinal"), F.col("label").cast("string").alias("label"), F.expr("slice(embedding, 1, 63)").alias("v")).select("ordinal", "label", vectors.sign_bits("v").alias("words"))


@query("j18_nearest_template", f"""
WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, {_BITS} AS b FROM embeddings),
 d AS (SELECT a.vec_id AS ordinal, t.vec_id AS o, t.label AS l, {_HAM} / 63.0 AS d FROM v a, v t WHERE t.vec_id < 30),
 n AS (SELECT ordinal, arg_min(l, (d, o)) AS label, min(d) AS score FROM d GROUP BY ordinal)
SELECT n.ordinal, n.label, round(n.score, 6) AS score, round(min(d.d) FILTER (WHERE d.l <> n.label), 6) AS other FROM n JOIN d USING (ordinal) GROUP BY ALL""")
def nearest_template(t):
    signs = _signs(t)
    out = templates.nearest(signs.select("ordinal", "words"), signs.where("ordinal < 30"), "ordinal", 63)
    return out.select("ordinal", "label", F.round("score", 6).alias("score"), F.round("other", 6).alias("other"))


@query("v05_leave_one_out", f"""
WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, {_BITS} AS b FROM embeddings),
 d AS (SELECT a.vec_id AS ordinal, a.label, t.vec_id AS o, t.label AS l, {_HAM} / 63.0 AS d FROM v a JOIN v t ON a.vec_id <> t.vec_id),
 n AS (SELECT ordinal, label, arg_min(l, (d, o)) AS predicted, min(d) FILTER (WHERE l = label) AS same, min(d) FILTER (WHERE l <> label) AS other FROM d GROUP BY ALL)
SELECT label, count(*) AS samples, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(same), 6) AS mean_same, round(sum(coalesce(other, 0)) / count(*), 6) AS mean_other FROM n GROUP BY label""")
def leave_one_out(t):
    out = templates.evaluation(templates.leave_one_out(_signs(t), 63))
    return out.select("label", "samples", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_same", "mean_other")])


@query("v03_regions", "SELECT CAST(o_custkey AS BIGINT) AS region, string_agg(CAST(o_orderkey % 10 AS VARCHAR), '' ORDER BY o_orderkey) AS text, bool_and(o_orderkey % 3 > 0) AS recognised, max(o_totalprice) AS worst FROM orders GROUP BY o_custkey")
def regions(t):
    glyphs = t.orders.select(F.col("o_custkey").alias("region"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 10).cast("string").alias("label"), (F.col("o_orderkey") % 3 > 0).alias("confident"), F.col("o_totalprice").alias("score"))
    return templates.read_regions(glyphs, "region", "place")


@query("v04_distinct_templates", f"SELECT min(vec_id) AS ordinal, CAST(label AS VARCHAR) AS label FROM embeddings GROUP BY label, list_transform(list_slice(embedding, 1, 2), lambda x: x > 0)")
def distinct_templates(t):
    rows = t.embeddings.select(F.col("vec_id").alias("ordinal"), F.col("label").cast("string").alias("label"), F.expr("slice(embedding, 1, 2)").alias("v"))
    return templates.distinct_templates(rows.select("ordinal", "label", vectors.sign_bits("v").alias("words"))).select("ordinal", "label")


@query("v04_thinned_templates", f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, list_transform(list_slice(embedding, 1, 24), lambda x: x > 0) AS b, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
 s(label, n, vec_id, kept) AS (SELECT DISTINCT label, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BOOLEAN[][]) FROM v
  UNION ALL
  SELECT label, n, CASE WHEN fresh THEN vec_id END, CASE WHEN fresh THEN list_append(kept, b) ELSE kept END FROM (
   SELECT v.label, v.n, v.vec_id, v.b, s.kept, len(list_filter(s.kept, lambda k: list_sum(list_transform(range(1, 25), lambda i: CASE WHEN v.b[i] <> k[i] THEN 1 ELSE 0 END)) <= 4)) = 0 AS fresh FROM s JOIN v ON v.label = s.label AND v.n = s.n + 1))
SELECT vec_id AS ordinal, label FROM s WHERE vec_id IS NOT NULL""")
def thinned_templates(t):
    rows = t.embeddings.select(F.col("vec_id").alias("ordinal"), F.col("label").cast("string").alias("label"), F.expr("slice(embedding, 1, 24)").alias("v"))
    return templates.thinned(rows.select("ordinal", "label", vectors.sign_bits("v").alias("words")), 4).select("ordinal", "label")


@query("v06_routed", "SELECT o_orderkey, CAST(o_orderkey AS INT) AS speed, 'x ' || o_custkey AS birthplace FROM orders")
def routed(t):
    row = lambda kind, name, first, second: t.orders.select("o_orderkey", F.lit(kind).alias("kind"), F.lit(name).alias("name"), first.alias("recognised"), second.alias("ocr"))
    fields = row("attribute", "speed", F.lit(None).cast("string"), F.col("o_orderkey").cast("string")).union(row("attribute", "lost", F.lit("?"), F.lit("1"))).union(row("text", "birthplace", F.concat(F.lit(" x  "), "o_custkey"), F.lit("no")))
    out = templates.routed(fields, "o_orderkey")
    return out.select("o_orderkey", F.col("attributes")["speed"].alias("speed"), F.col("texts")["birthplace"].alias("birthplace"))


def season_games(t):
    key = F.col("l_orderkey")
    return t.lineitem.select(
        F.lit(0).alias("league_id"), F.expr("cast(l_suppkey % 8 as int)").alias("season"), F.to_date("l_shipdate").alias("sim_date"), (key * 10 + F.col("l_linenumber")).alias("ordinal"),
        (key % 16).alias("home_team_id"), ((key + 1 + F.col("l_partkey") % 15) % 16).alias("away_team_id"),
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.0).alias("score"), (F.col("l_linestatus") == "F").alias("played"),
    )


@query("e05_season_ratings", """
WITH RECURSIVE every AS (SELECT CAST(l_suppkey % 8 AS INT) AS season, CAST(l_shipdate AS DATE) AS d, l_orderkey * 10 + l_linenumber AS o, l_orderkey % 16 AS h, (l_orderkey + 1 + l_partkey % 15) % 16 AS a,
  CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, l_linestatus = 'F' AS played FROM lineitem),
 g AS (SELECT season, row_number() OVER (PARTITION BY season ORDER BY d, o) AS k, h, a, score FROM every WHERE played),
 s(season, k, r, n, h, a) AS (SELECT DISTINCT season, 0::BIGINT, list_transform(range(16), lambda i: 1000), list_transform(range(16), lambda i: 0), 0::BIGINT, 0::BIGINT FROM every
  UNION ALL
  SELECT season, k, list_transform(range(16), lambda i: CASE i WHEN h THEN CAST(trunc(greatest(rh + fh * (score - e), 100.0)) AS INT) WHEN a THEN CAST(trunc(greatest(ra + fa * ((1 - score) - (1 - e)), 100.0)) AS INT) ELSE r[i + 1] END),
   list_transform(range(16), lambda i: CASE WHEN i = h OR i = a THEN n[i + 1] + 1 ELSE n[i + 1] END), h, a
  FROM (SELECT *, 1 / (1 + pow(10, (ra - rh) / 400.0::DOUBLE)) AS e, CASE WHEN rh < 1800 AND n[h + 1] < 30 THEN 100 WHEN rh < 1800 THEN 50 ELSE 10 END AS fh, CASE WHEN ra < 1800 AND n[a + 1] < 30 THEN 100 WHEN ra < 1800 THEN 50 ELSE 10 END AS fa
   FROM (SELECT g.season, g.k, g.h, g.a, g.score, s.r, s.n, s.r[g.h + 1] AS rh, s.r[g.a + 1] AS ra FROM s JOIN g ON g.season = s.season AND g.k = s.k + 1)))
SELECT 0 AS league_id, season, h AS team_id, 0 AS games_played, 1000 AS rating FROM (SELECT DISTINCT season, h FROM every)
UNION ALL SELECT 0, season, h, n[h + 1], r[h + 1] FROM s WHERE k > 0
UNION ALL SELECT 0, season, a, n[a + 1], r[a + 1] FROM s WHERE k > 0
""")
def season_ratings(t):
    games = season_games(t)
    teams = games.select("league_id", "season", F.col("home_team_id").alias("team_id")).distinct()
    return rating.season_ratings(games, teams)


@query("x18_distance", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] - b.embedding[i] AS DOUBLE), 2))), 5) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distance(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select("vec_id", F.round(vectors.squared_distance(F.col("embedding"), F.col("other")), 5).alias("d"))


@query("x20_bit_strings", "SELECT p_partkey, substr(repeat('1101', 30), 1, 1 + p_size) AS bits, CAST((1 + p_size + 31) // 32 AS INT) AS words FROM part")
def bit_strings(t):
    bits = F.substring(F.repeat(F.lit("1101"), 30), F.lit(1), F.col("p_size") + 1)
    rows = t.part.select("p_partkey", bits.alias("b")).withColumn("w", vectors.bit_string_words(F.col("b")))
    return rows.select("p_partkey", vectors.words_bit_string(F.col("w"), F.length("b")).alias("bits"), F.size("w").alias("words"))


@query("u08_all_equal", "SELECT o_orderkey, o_orderkey % 3 = 0 AS same FROM orders")
def all_equal(t):
    second = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1)
    return t.orders.select("o_orderkey", vectors.all_equal(F.array("o_orderkey", "o_custkey"), F.array(F.col("o_orderkey"), second)).alias("same"))
