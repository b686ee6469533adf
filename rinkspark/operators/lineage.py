"""Lineage totals of all recruiters without listing who reaches whom, and lineage trees as documents.

A member has one recruiter, so members whose recruiter is the only member of its name form trees, some
of which hang off a cycle. Cycles are what is left of the image when ancestors are doubled, and each is
cut open at its least member. Sums over all descendants then take as many rounds as the depth has
binary digits: what is known of a member's next 2^k generations is sent to its 2^k-th ancestor, one row
a member and round. A name that several members share has parents in several trees; such names are
roots of their own, and the trees are kept apart: a recruiter's lineage is its own part and the whole
of each shared name that it reaches. Only pairs with shared names are ever listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.operators import recruitment
from rinkspark.session import checkpoints


def jumps(up: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """([(id, at), ...], cycles): each node's ancestor 1, 2, 4, ... steps up ``up(id, at)``, of those that have one.

    Ends where no node has one, or where as many nodes as before are somebody's ancestor: those are the
    nodes on cycles, and the second part holds them as ``id``.
    """
    out, before, now = [], None, up.checkpoint()
    while True:
        tops = now.select(F.col("at").alias("id")).distinct()
        n = tops.count()
        if not n:
            return out, None
        if n == before:
            return out, tops
        out.append(now)
        before = n
        further = now.select(F.col("id").alias("at"), F.col("at").alias("_next"))
        now = now.join(further, "at").select("id", F.col("_next").alias("at")).checkpoint()


def least_of_cycles(ring: DataFrame) -> DataFrame:
    """(id, rep) of the nodes of ``ring(id, at)``, each on a cycle: the least id of its cycle."""
    now = ring.withColumn("rep", F.col("id")).checkpoint()
    while True:
        further = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("rep").alias("_rep"))
        both = now.join(further, "at").select("id", F.col("_at").alias("at"), F.least("rep", "_rep").alias("rep"), (F.col("_rep") < F.col("rep")).alias("_less")).checkpoint()
        now = both.drop("_less")
        if both.where("_less").isEmpty():
            return now.select("id", "rep")


def subtree_sums(weights: DataFrame, steps: list[DataFrame], values: list[str]) -> DataFrame:
    """``weights(id, *values)`` summed over each node and all its descendants, by the ancestors of ``jumps``."""
    now = weights
    for step in steps:
        sent = step.join(now, "id").groupBy("at").agg(*(F.sum(v).alias(f"_{v}") for v in values)).withColumnRenamed("at", "id")
        now = now.join(sent, "id", "left").select("id", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)).checkpoint()
    return now


def _closed(pairs: DataFrame) -> DataFrame:
    """The transitive closure of ``pairs(a, b)`` between shared names."""
    n, now = -1, pairs.distinct().checkpoint()
    while (m := now.count()) != n:
        n = m
        further = now.select(F.col("a").alias("b"), F.col("b").alias("_b"))
        now = now.unionByName(now.join(further, "b").select("a", F.col("_b").alias("b"))).distinct().checkpoint()
    return now


def totals(edges: DataFrame) -> DataFrame:
    """(category, recruiter_key, lineage_users, lineage_tpe) of every recruiter of ``edges``: the members it reaches, each once.

    ``edges(category, recruiter_key, user_id, username, career_tpe)`` has one row a member. A recruiter
    on a cycle reaches itself, and counts; only members that recruit as players have recruits of their own.
    """
    checkpoints(edges.sparkSession)
    up = F.when(F.col("category") == recruitment.PLAYER, F.lower("recruiter_key"))
    users = edges.where("user_id is not null").select(F.col("user_id").alias("id"), F.lower("username").alias("name"), up.alias("up"), F.col("career_tpe").alias("tpe"))
    names = users.where("name is not null").groupBy("name").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n"))
    owners = names.select(F.col("name").alias("up"), F.when(F.col("n") == 1, F.col("owner")).alias("at"), (F.col("n") > 1).alias("_shared"))
    nodes = users.join(owners, "up", "left").select("id", "name", "at", F.when(F.col("_shared"), F.col("up")).alias("shared"), F.coalesce("tpe", F.lit(0)).alias("tpe")).checkpoint()
    ups = nodes.where("at is not null").select("id", "at")
    steps, on_cycles = jumps(ups)
    cycles = None
    if on_cycles is not None:
        cycles = least_of_cycles(ups.join(on_cycles, "id", "left_semi"))
        steps, _ = jumps(ups.join(cycles.where("id = rep").select("id"), "id", "left_anti"))
    sums = subtree_sums(nodes.select("id", F.lit(1).cast("long").alias("users"), "tpe"), steps, ["users", "tpe"])
    keys = edges.where("user_id is not null").select("category", "recruiter_key", F.col("user_id").alias("id"))
    own = keys.join(sums, "id").groupBy("category", "recruiter_key").agg(F.sum("users").alias("lineage_users"), F.sum("tpe").alias("lineage_tpe"))
    # a recruiter that is one member: itself, and the member whose sums hold its whole cycle
    member = names.where("n = 1").select(F.col("name").alias("_low"), F.col("owner").alias("id"))
    low = F.when(F.col("category") == recruitment.PLAYER, F.lower("recruiter_key"))
    own = own.withColumn("_low", low).join(member, "_low", "left")
    if cycles is not None:
        whole = cycles.join(sums.select(F.col("id").alias("rep"), F.col("users").alias("_users"), F.col("tpe").alias("_tpe")), "rep")
        own = own.join(whole, "id", "left")
        own = own.select("category", "recruiter_key", "_low", "id", "rep", F.coalesce("_users", "lineage_users").alias("lineage_users"), F.coalesce("_tpe", "lineage_tpe").alias("lineage_tpe"))
    own = own.checkpoint()
    if nodes.where("shared is not null").isEmpty():
        return own.select("category", "recruiter_key", "lineage_users", "lineage_tpe")
    return _with_shared(nodes, steps, sums, cycles, keys, own)


def _with_shared(nodes: DataFrame, steps: list[DataFrame], sums: DataFrame, cycles: DataFrame | None, keys: DataFrame, own: DataFrame) -> DataFrame:
    """``own`` and the members below the shared names that each recruiter reaches."""
    used = nodes.where("shared is not null").select(F.col("shared").alias("name")).distinct()
    below = nodes.join(used, "name", "left_semi").select("id", F.col("name").alias("y")).distinct().checkpoint()  # (member, shared name at or below it)
    root = nodes.where("shared is not null").select("id", F.col("shared").alias("root")).checkpoint()  # (member, shared name its tree hangs from)
    for step in steps:
        below = below.unionByName(below.join(step, "id").select(F.col("at").alias("id"), "y")).distinct().checkpoint()
        root = root.unionByName(step.join(root.withColumnRenamed("id", "at"), "at").select("id", "root")).checkpoint()
    reaches = _closed(nodes.where("shared is not null").select("id", F.col("shared").alias("a")).join(below, "id").select("a", F.col("y").alias("b")))
    parts = nodes.where("shared is not null").select("id", F.col("shared").alias("y")).join(sums, "id").groupBy("y").agg(F.sum("users").alias("_u"), F.sum("tpe").alias("_t"))
    by = ["category", "recruiter_key"]
    direct = keys.join(below, "id").select(*by, "y")
    if cycles is not None:
        direct = direct.unionByName(own.where("rep is not null").select(*by, F.col("rep").alias("id")).join(below, "id").select(*by, "y"))
    direct = direct.distinct().checkpoint()
    every = direct.unionByName(direct.join(reaches.select(F.col("a").alias("y"), "b"), "y").select(*by, F.col("b").alias("y"))).distinct()
    # a recruiter whose own tree hangs from a name that it reaches is part of that name's sums, as is a shared name of its own
    home = own.join(root, "id", "left").select(*by, F.coalesce("root", "_low").alias("home"))
    found = every.join(parts, "y").join(home, by, "left")
    more = found.groupBy(*by).agg(F.sum("_u").alias("_u"), F.sum("_t").alias("_t"), F.max(F.coalesce(F.col("y") == F.col("home"), F.lit(False))).alias("_inside"))
    kept = F.when(F.coalesce("_inside", F.lit(False)), 0).otherwise(1)
    both = own.join(more, by, "left")
    return both.select(*by, *((F.col(c) * kept + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("lineage_users", "_u"), ("lineage_tpe", "_t"))))


def document(edges: DataFrame, root: str, most_depth: int = recruitment.MOST_DEPTH) -> DataFrame:
    """(recruiter_key, category, document): one recruiter's lineage as nested JSON, a row if it is addressable.

    A node has userId, name, category, careerTpe, subtreeUsers and subtreeCareerTpe (both without the
    node itself) and recruited, its recruits by TPE, name in any case and id. Levels are folded from the
    deepest up, so that each round joins one level of nodes to their finished recruits.
    """
    nodes = recruitment.tree(edges, root, most_depth).checkpoint()
    kids = edges.select("user_id", "category")
    nodes = nodes.join(kids, "user_id").checkpoint()
    done, deepest = None, nodes.agg(F.max("depth")).first()[0] or 0

    def written(df: DataFrame, user: str) -> DataFrame:
        head = F.to_json(F.struct(F.expr(user).alias("userId"), F.col("username").alias("name"), "category", F.col("career_tpe").alias("careerTpe"), F.col("users").alias("subtreeUsers"), F.col("tpe").alias("subtreeCareerTpe")), {"ignoreNullFields": "false"})
        return F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"recruited":['), F.coalesce("inner", F.lit("")), F.lit("]}")), head

    for depth in range(deepest, -1, -1):
        if depth:
            level = nodes.where(F.col("depth") == depth).select("user_id", "username", "category", "career_tpe", "parent_id")
        else:
            tally = recruitment.addressable(recruitment.tallies(edges), root)
            level = tally.select(F.lit(None).cast(nodes.schema["user_id"].dataType).alias("user_id"), F.col("recruiter_key").alias("username"), "category", F.lit(0).cast("long").alias("career_tpe"), F.lit(None).cast(nodes.schema["user_id"].dataType).alias("parent_id"))
        if done is None:
            level = level.select("*", F.lit(0).cast("long").alias("users"), F.lit(0).cast("long").alias("tpe"), F.lit(None).cast("string").alias("inner"))
        else:
            order = F.array_sort(F.collect_list(F.struct((-F.col("career_tpe")).alias("t"), F.lower("username").alias("n"), "user_id", "doc")))
            joined = F.array_join(F.transform(order, lambda x: x["doc"]), ",")
            inside = done.groupBy("parent_id").agg(joined.alias("inner"), F.sum(F.col("users") + 1).alias("users"), F.sum(F.col("tpe") + F.col("career_tpe")).alias("tpe")).withColumnRenamed("parent_id", "_id")
            own = level["user_id"].eqNullSafe(inside["_id"])
            level = level.join(inside, own, "left").select(*level.columns, F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("tpe", F.lit(0)).alias("tpe"), "inner")
        doc, head = written(level, "user_id")
        done = level.withColumn("head", head).withColumn("doc", doc).drop("head", "inner").checkpoint()
    return done.select(F.col("username").alias("recruiter_key"), "category", F.col("doc").alias("document"))
