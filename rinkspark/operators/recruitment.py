"""Recruitment: members by owner, recruiters classified, tallies, lineage and its trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.text import trimmed

PLAYER, EXTERNAL, SELF, NONE = 0, 1, 2, 3
ORDERS = ("users", "tpe", "lineage_users", "lineage_tpe")
MOST_RECRUITERS = 500
MOST_DEPTH = 32
#: How a member names themselves as their own recruiter, and how that is reported.
MYSELF = "Myself"


def consolidated(players: DataFrame) -> DataFrame:
    """(user_id, username, recruiter, career_tpe): name and recruiter of a user's earliest player, all TPE.

    Takes (user_id, player_id, username, recruiter, creation_time, latest_tpe).
    """
    first = F.min_by(F.struct("username", "recruiter"), F.struct("creation_time", "player_id")).alias("_f")
    out = players.groupBy("user_id").agg(first, F.sum(F.coalesce("latest_tpe", F.lit(0)).cast("long")).alias("career_tpe"))
    return out.select("user_id", "_f.username", "_f.recruiter", "career_tpe")


def classified(users: DataFrame, members: DataFrame) -> DataFrame:
    """Adds (category, recruiter_key): a member's name in its own case, Myself, the trimmed text, or empty.

    ``members(name, ordinal)`` match in any case, the first casing wins, and before Myself does.
    """
    names = members.where(F.col("name").isNotNull()).groupBy(F.lower(trimmed(F.col("name"))).alias("_low")).agg(F.min_by("name", "ordinal").alias("_member"))
    text = trimmed(F.coalesce("recruiter", F.lit("")))
    out = users.withColumn("_low", F.lower(text)).join(names, "_low", "left")
    blank, own = text == "", F.col("_low") == MYSELF.lower()
    category = F.when(blank, NONE).when(F.col("_member").isNotNull(), PLAYER).when(own, SELF).otherwise(EXTERNAL)
    key = F.when(blank, "").when(F.col("_member").isNotNull(), F.col("_member")).when(own, MYSELF).otherwise(text)
    return out.select(*users.columns, category.alias("category"), key.alias("recruiter_key"))


def lineage(edges: DataFrame, roots: DataFrame | None = None, checkpoint: bool = True, hops: int = 4) -> DataFrame:
    """(category, recruiter_key, user_id, depth): all members that each recruiter reaches, each once.

    Each round joins the frontier to the players' recruits ``hops`` times in one plan, takes out what
    was seen and cuts the plan off, so cycles end and depth costs few rounds. A recruiter on a cycle
    reaches itself again, and counts. ``roots`` restricts the recruiters; only members that recruit
    as players have recruits of their own. The list grows with the depth; for counts and sums of all
    recruiters take ``lineage.totals``.
    """
    by = ["category", "recruiter_key", "user_id"]
    seen = edges.select(*by, "username").withColumn("depth", F.lit(1))
    if roots is not None:
        seen = seen.join(roots.select("category", "recruiter_key"), ["category", "recruiter_key"], "left_semi")
    kids = edges.where(F.col("category") == PLAYER).select(F.lower("recruiter_key").alias("_low"), F.col("user_id").alias("_kid"), F.col("username").alias("_name"))
    frontier, reached = seen, 1
    while True:
        steps = []
        for _ in range(hops):
            frontier = frontier.withColumn("_low", F.lower("username")).join(kids, "_low")
            frontier = frontier.select("category", "recruiter_key", F.col("_kid").alias("user_id"), F.col("_name").alias("username"), (F.col("depth") + 1).alias("depth"))
            steps.append(frontier)
        new = steps[0]
        for step in steps[1:]:
            new = new.unionByName(step)
        new = new.groupBy(*by).agg(F.min(F.struct("depth", "username")).alias("_n")).select(*by, "_n.username", "_n.depth")
        new = new.join(seen.select(*by), by, "left_anti")
        new = new.checkpoint() if checkpoint else new.persist()
        if new.isEmpty():
            return seen.drop("username")
        reached += hops
        seen, frontier = seen.unionByName(new), new.where(F.col("depth") == reached)


def tallies(edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """(category, recruiter_key, users, tpe[, lineage_users, lineage_tpe]) of each recruiter.

    ``reached`` has the totals of ``lineage.totals``, or the members that ``lineage`` lists.
    """
    out = edges.groupBy("category", "recruiter_key").agg(F.count(F.lit(1)).alias("users"), F.sum("career_tpe").alias("tpe"))
    if reached is None:
        return out
    if "lineage_users" in reached.columns:
        return out.join(reached, ["category", "recruiter_key"], "left")
    tpe = edges.groupBy("user_id").agg(F.first("career_tpe").alias("career_tpe"))
    down = reached.join(tpe, "user_id").groupBy("category", "recruiter_key").agg(F.countDistinct("user_id").alias("lineage_users"), F.sum("career_tpe").alias("lineage_tpe"))
    return out.join(down, ["category", "recruiter_key"], "left")


def summary(of_tallies: DataFrame) -> DataFrame:
    """(category, recruiters, users, tpe), in order of category."""
    by = of_tallies.groupBy("category").agg(F.count(F.lit(1)).alias("recruiters"), F.sum("users").alias("users"), F.sum("tpe").alias("tpe"))
    return by.orderBy("category")


def in_order(of_tallies: DataFrame, by: str = "users", limit: int | None = None) -> DataFrame:
    """Recruiters by one of four keys, ties by name in any case and category; 500 at most."""
    if by not in ORDERS:
        raise ValueError(f"unknown order: {by}")
    then: list[Column] = [F.col("tpe").desc()] if by == "users" else []
    out = of_tallies.orderBy(F.col(by).desc(), *then, F.lower("recruiter_key"), "category")
    return out if limit is None else out.limit(min(max(limit, 1), MOST_RECRUITERS))


def addressable(of_tallies: DataFrame, name: str) -> DataFrame:
    """The recruiter of a name in any case, if it is a member or an outside name."""
    return of_tallies.where(F.col("category").isin(PLAYER, EXTERNAL) & (F.lower("recruiter_key") == name.lower()))


def tree(edges: DataFrame, root: str, most_depth: int = MOST_DEPTH, checkpoint: bool = True) -> DataFrame:
    """(user_id, username, parent_id, depth, path, career_tpe, subtree_users, subtree_tpe) below one recruiter.

    A member is placed where it is first reached; a name that several members share gives children to
    the one placed first. The roll-up counts every node at each of its ancestors along the path.
    """
    most_depth = min(max(most_depth, 1), MOST_DEPTH)
    top = edges.where((F.lower("recruiter_key") == root.lower()) & F.col("category").isin(PLAYER, EXTERNAL))
    level = top.select("user_id", "username", "career_tpe", F.lit(None).cast(edges.schema["user_id"].dataType).alias("parent_id"), F.lit(1).alias("depth"), F.array("user_id").alias("path"))
    level = level.dropDuplicates(["user_id"])
    nodes = level
    kids = edges.where(F.col("category") == PLAYER).select(F.lower("recruiter_key").alias("_low"), F.col("user_id").alias("_kid"), F.col("username").alias("_name"), F.col("career_tpe").alias("_tpe"))
    for _ in range(most_depth - 1):
        nxt = level.withColumn("_low", F.lower("username")).join(kids, "_low")
        nxt = nxt.select(F.col("_kid").alias("user_id"), F.col("_name").alias("username"), F.col("_tpe").alias("career_tpe"), F.col("user_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_kid")).alias("path"))
        first = F.min_by(F.struct("username", "career_tpe", "parent_id", "depth", "path"), F.col("path")).alias("_n")
        nxt = nxt.groupBy("user_id").agg(first).select("user_id", "_n.*").select(*nodes.columns)
        nxt = nxt.join(nodes.select("user_id"), "user_id", "left_anti").select(*nodes.columns)
        nxt = nxt.checkpoint() if checkpoint else nxt
        if nxt.isEmpty():
            break
        nodes, level = nodes.unionByName(nxt), nxt
    roll = nodes.select(F.explode("path").alias("user_id"), F.col("career_tpe").alias("_t")).groupBy("user_id").agg(F.count(F.lit(1)).alias("subtree_users"), F.sum("_t").alias("subtree_tpe"))
    return nodes.join(roll, "user_id")
