import json
import random

import pytest
from pyspark.sql import functions as F

from rinkspark.operators import lineage, recruitment

EDGES = "category int, recruiter_key string, user_id long, username string, career_tpe long"


def _naive(rows):
    """Each recruiter's lineage by walking from its recruits."""
    kids, groups = {}, {}
    for category, key, user, name, tpe in rows:
        groups.setdefault((category, key), []).append((user, name, tpe))
        if category == recruitment.PLAYER:
            kids.setdefault(key.lower(), []).append((user, name, tpe))
    out = {}
    for group, direct in groups.items():
        seen, left = {}, list(direct)
        while left:
            user, name, tpe = left.pop()
            if user not in seen:
                seen[user] = tpe or 0
                left += kids.get((name or "").lower(), [])
        out[group] = len(seen), sum(seen.values())
    return out


def _random(seed, shared):
    rng = random.Random(seed)
    n = rng.randint(8, 30)
    names = [f"u{rng.randint(0, n) if shared else i}" for i in range(n)]
    rows = []
    for i in range(n):
        name = names[i].upper() if rng.random() < 0.3 else names[i]
        player = rng.random() < 0.8
        rows.append((0, rng.choice(names), i, name, rng.randint(0, 9)) if player else (rng.choice([1, 2, 3]), rng.choice(["Google", "x"]), i, name, None))
    return rows


@pytest.mark.parametrize(("seed", "shared"), [(1, False), (2, False), (3, True), (4, True), (5, True)])
def test_totals_match_a_walk(spark, seed, shared):
    rows = _random(seed, shared)
    got = {(r.category, r.recruiter_key): (r.lineage_users, r.lineage_tpe) for r in lineage.totals(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == _naive(rows)


def test_a_name_reached_twice_counts_once(spark):
    rows = [(1, "out", 1, "a", 1), (0, "a", 2, "twin", 10), (0, "a", 3, "b", 100), (0, "b", 4, "Twin", 1000), (0, "twin", 5, "c", 10_000), (0, "c", 6, "twin", 100_000)]
    got = {r.recruiter_key: (r.lineage_users, r.lineage_tpe) for r in lineage.totals(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == {"out": (6, 111_111), "a": (5, 111_110), "b": (3, 111_000), "twin": (2, 110_000), "c": (2, 110_000)}


def test_long_chains_take_few_rounds(spark):
    n = 20_000
    chain = spark.range(n).select(F.when(F.col("id") == 0, 1).otherwise(0).alias("category"), F.when(F.col("id") == 0, "out").otherwise(F.concat(F.lit("m"), F.col("id") - 1)).alias("recruiter_key"), F.col("id").alias("user_id"), F.concat(F.lit("m"), F.col("id")).alias("username"), F.lit(1).cast("long").alias("career_tpe"))
    steps, cycles = lineage.jumps(chain.where("user_id > 0").select(F.col("user_id").alias("id"), (F.col("user_id") - 1).alias("at")).repartition(4))
    assert cycles is None and len(steps) == 15 and max(s.count() for s in steps) < n
    got = {r.recruiter_key: r.lineage_users for r in lineage.totals(chain.where("user_id < 3000")).collect()}
    assert got == {"out": 3000} | {f"m{i}": 2999 - i for i in range(2999)}


def test_empty_and_unnamed(spark):
    assert lineage.totals(spark.createDataFrame([], EDGES)).count() == 0
    rows = [(0, "a", 1, None, 5), (0, "gone", 2, "a", None), (3, "", None, "a", 7)]
    got = {r.recruiter_key: (r.lineage_users, r.lineage_tpe) for r in lineage.totals(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == {"a": (1, 5), "gone": (2, 5)}


def test_documents(spark):
    rows = [(1, "Out", 1, "a", 100), (1, "Out", 2, "b \"x\"", 200), (0, "a", 3, "c", 5), (0, "a", 4, "B", 5), (0, "a", 5, "b", 5), (0, "c", 6, "deep", 7), (0, "deep", 7, "a2", 1)]
    edges = spark.createDataFrame(rows, EDGES)
    [r] = lineage.document(edges, "OUT", 3).collect()
    leaf = {"category": 0, "subtreeUsers": 0, "subtreeCareerTpe": 0, "recruited": []}
    deep = {"userId": 6, "name": "deep", "careerTpe": 7} | leaf
    inside = [{"userId": 4, "name": "B", "careerTpe": 5} | leaf, {"userId": 5, "name": "b", "careerTpe": 5} | leaf]
    inside += [{"userId": 3, "name": "c", "careerTpe": 5} | leaf | {"subtreeUsers": 1, "subtreeCareerTpe": 7, "recruited": [deep]}]
    top = {"userId": None, "name": "Out", "category": 1, "careerTpe": 0, "subtreeUsers": 6, "subtreeCareerTpe": 322}
    assert json.loads(r.document) == top | {"recruited": [{"userId": 2, "name": 'b "x"', "category": 1, "careerTpe": 200, "subtreeUsers": 0, "subtreeCareerTpe": 0, "recruited": []}, {"userId": 1, "name": "a", "category": 1, "careerTpe": 100, "subtreeUsers": 4, "subtreeCareerTpe": 22, "recruited": inside}]}
    assert lineage.document(edges, "nobody").count() == 0
