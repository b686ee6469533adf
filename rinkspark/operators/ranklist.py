"""Ordered-list algebra: entries of boards with dense ranks 1..n while active, rank 0 once rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.operators import lookup

REJECTED = "Rejected"


class Conflict(ValueError):
    """The board is not in the state that a change needs."""


def _ranked(df: DataFrame, board: str, key: str) -> DataFrame:
    """Dense ranks for the active, those with a rank first, ties by key; 0 for the rejected."""
    active = F.col("status") != REJECTED
    order = [F.when(F.col("rank") > 0, 0).otherwise(1), F.col("rank"), F.col(key)]
    nth = F.row_number().over(Window.partitionBy(board, active).orderBy(*order))
    return df.withColumn("rank", F.when(active, nth).otherwise(F.lit(0)).cast("int"))


def compacted(entries: DataFrame, board: str = "board_id", key: str = "player_id") -> DataFrame:
    return _ranked(entries, board, key)


def appended(entries: DataFrame, new: DataFrame, board: str = "board_id", key: str = "player_id", status: str = "Pending") -> DataFrame:
    """Adds the entries of ``new(board, key, ordinal)`` that are not there, after the last rank."""
    top = entries.groupBy(board).agg(F.max("rank").alias("_top"))
    fresh = new.join(entries.select(board, key), [board, key], "left_anti").groupBy(board, key).agg(F.min("ordinal").alias("ordinal"))
    nth = F.row_number().over(Window.partitionBy(board).orderBy("ordinal"))
    fresh = fresh.join(top, board, "left").withColumn("rank", (F.coalesce("_top", F.lit(0)) + nth).cast("int")).withColumn("status", F.lit(status))
    return entries.unionByName(fresh.drop("_top", "ordinal"), allowMissingColumns=True)


def added(entries: DataFrame, board_id, player_id, board: str = "board_id", key: str = "player_id") -> DataFrame:
    """One more entry; it is a conflict if the board has it."""
    if not entries.where((F.col(board) == board_id) & (F.col(key) == player_id)).isEmpty():
        raise Conflict(f"{player_id} is on the board")
    row = entries.sparkSession.createDataFrame([(board_id, player_id, 0)], [board, key, "ordinal"])
    row = row.select(F.col(board).cast(entries.schema[board].dataType), F.col(key).cast(entries.schema[key].dataType), "ordinal")
    return appended(entries, row, board, key)


def bulk_added(entries: DataFrame, board_id, wanted: DataFrame, players: DataFrame, id_column: str, name_column: str, board: str = "board_id", key: str = "player_id") -> tuple[DataFrame, DataFrame]:
    """(entries, report(outcome, id, name)) after adding ids and names; an ambiguous name rejects all."""
    resolved = lookup.resolve(wanted, players, id_column, name_column)
    if not resolved.where("outcome = 'ambiguous'").isEmpty():
        raise Conflict("a name is ambiguous")
    ids = lookup.found_ids(resolved).withColumn(board, F.lit(board_id)).withColumnRenamed("id", key)
    there = entries.where(F.col(board) == board_id).select(key, F.lit(True).alias("_there"))
    report = resolved.join(there.withColumnRenamed(key, "_k"), F.get("ids", F.lit(0)) == F.col("_k"), "left")
    outcome = F.when(F.col("outcome") == "not_found", "not_found").when(F.col("_there"), "already").otherwise("added")
    report = report.select("ordinal", outcome.alias("outcome"), F.coalesce("id", F.get("ids", F.lit(0))).alias("id"), "name")
    typed = ids.select(F.col(board).cast(entries.schema[board].dataType), F.col(key).cast(entries.schema[key].dataType), "ordinal")
    return appended(entries, typed, board, key), report


def removed(entries: DataFrame, keys: DataFrame, board: str = "board_id", key: str = "player_id") -> DataFrame:
    """Without the entries of ``keys``; the active close up."""
    return _ranked(entries.join(keys.select(board, key).distinct(), [board, key], "left_anti"), board, key)


def without_comments(comments: DataFrame, gone: DataFrame, entry: str = "entry_id") -> DataFrame:
    """Comments whose entry stays; those of a whole board have no entry and stay too."""
    return comments.join(gone.select(entry).distinct(), entry, "left_anti")


def moved(entries: DataFrame, board_id, source: int, target: int, player_id=None, board: str = "board_id", key: str = "player_id") -> DataFrame:
    """The entry at rank ``source`` goes to ``target`` and those between shift by one.

    Both ranks must be active ones; with ``player_id`` the entry there must be that player's.
    """
    here = (F.col(board) == board_id) & (F.col("status") != REJECTED)
    found = entries.where(here).agg(F.max("rank").alias("top"), F.max(F.when(F.col("rank") == source, F.col(key))).alias("who")).first()
    if not found.top or not 1 <= source <= found.top or not 1 <= target <= found.top:
        raise Conflict("a rank is out of range")
    if player_id is not None and found.who != player_id:
        raise Conflict(f"rank {source} is not {player_id}'s")
    rank = F.col("rank")
    shift = F.when(rank == source, target)
    shift = shift.when(rank.between(source + 1, target), rank - 1) if source < target else shift.when(rank.between(target, source - 1), rank + 1)
    return entries.withColumn("rank", F.when(here, shift.otherwise(rank)).otherwise(rank).cast("int"))


def moved_within(entries: DataFrame, board_id, player_id, target: int, board: str = "board_id", key: str = "player_id") -> DataFrame:
    """As ``moved``, from wherever the player is, the target held within the active ranks."""
    here = (F.col(board) == board_id) & (F.col("status") != REJECTED)
    found = entries.where(here).agg(F.max("rank").alias("top"), F.max(F.when(F.col(key) == player_id, F.col("rank"))).alias("at")).first()
    if not found.at:
        raise Conflict(f"{player_id} is not active")
    return moved(entries, board_id, found.at, min(max(target, 1), found.top), None, board, key)


def updated(entries: DataFrame, changes: DataFrame, board: str = "board_id", key: str = "player_id") -> DataFrame:
    """Takes status and assignee of ``changes(board, key, status, assigned_to)`` where they are not null.

    Rejected entries lose their rank and the active close up; restored ones go to the end in order
    of key. No one is assigned by null: use an empty string to clear.
    """
    new = changes.select(board, key, F.col("status").alias("_status"), F.col("assigned_to").alias("_to"))
    out = entries.join(new, [board, key], "left")
    status = F.coalesce("_status", "status")
    out = out.withColumn("status", status).withColumn("rank", F.when(status == REJECTED, 0).otherwise(F.col("rank")))
    if "assigned_to" in entries.columns:
        out = out.withColumn("assigned_to", F.when(F.col("_to") == "", None).otherwise(F.coalesce("_to", "assigned_to")))
    return _ranked(out.select(*entries.columns), board, key)


def counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 where there is none."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def sole_owner(members: DataFrame, team: str = "team_id", role: str = "role") -> DataFrame:
    """(team, sole_owner): whether a team has exactly one owner."""
    return members.groupBy(team).agg((F.sum(F.when(F.col(role) == "Owner", 1).otherwise(0)) == 1).alias("sole_owner"))


def capabilities(members: DataFrame, role: str = "role", admin: str | None = None) -> DataFrame:
    """What a role may do: viewers read and comment not, editors change boards, owners run the team."""
    level = F.when(F.col(role) == "Owner", 2).when(F.col(role) == "Editor", 1).when(F.col(role) == "Viewer", 0)
    power = F.coalesce(F.col(admin), F.lit(False)) if admin else F.lit(False)
    can = lambda n: F.coalesce(level >= n, F.lit(False)) | power
    return members.select("*", can(0).alias("can_view"), can(1).alias("can_edit"), can(2).alias("can_manage"))


def thread(comments: DataFrame, entry_id=None, entry: str = "entry_id") -> DataFrame:
    """Comments of one entry, or of the board itself where ``entry_id`` is none."""
    return comments.where(F.col(entry).eqNullSafe(F.lit(entry_id).cast(comments.schema[entry].dataType)))


def with_assignee(entries: DataFrame, users: DataFrame) -> DataFrame:
    """Entries with the name of whom they are assigned to; null where no one is, or is no user any more."""
    return entries.join(users.select(F.col("user_id").alias("assigned_to"), F.col("username").alias("assignee")), "assigned_to", "left").select(*entries.columns, "assignee")


def with_author(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Comments with their author's name, in order of time."""
    return comments.join(users.select(F.col("user_id").alias("author_id"), F.col("username").alias("author")), "author_id", "left").select(*comments.columns, "author").orderBy("created_at", "comment_id")


def edited_comments(comments: DataFrame, edits: DataFrame, members: DataFrame) -> DataFrame:
    """Comments after ``edits(comment_id, user_id, text, action)``, and whether each edit was ``allowed``.

    ``action`` is add, edit or delete. Viewers and outsiders may do nothing; authors edit and delete
    their own, owners delete any. Returns the edits with ``allowed``; ``applied_comments`` takes them.
    """
    role = members.select("team_id", F.col("user_id"), "role")
    asked = edits.join(role, ["team_id", "user_id"], "left").join(comments.select("comment_id", F.col("author_id").alias("_author")), "comment_id", "left")
    writes = F.col("role").isin("Owner", "Editor")
    own = F.col("_author").eqNullSafe(F.col("user_id"))
    allowed = F.when(F.col("action") == "add", writes & F.col("_author").isNull()).when(F.col("action") == "edit", writes & own).when(F.col("action") == "delete", F.col("_author").isNotNull() & (own & writes | (F.col("role") == "Owner")))
    return asked.select(*edits.columns, F.coalesce(allowed, F.lit(False)).alias("allowed"))


def applied_comments(comments: DataFrame, judged: DataFrame) -> DataFrame:
    """(comment_id, author_id, text) after the allowed edits, one a comment."""
    ok = judged.where("allowed").select("comment_id", F.col("user_id").alias("_user"), F.col("text").alias("_text"), "action")
    both = comments.join(ok, "comment_id", "full_outer").where(~F.col("action").eqNullSafe(F.lit("delete")))
    return both.select("comment_id", F.coalesce("author_id", "_user").alias("author_id"), F.when(F.col("action").isNotNull(), F.col("_text")).otherwise(F.col("text")).alias("text"))


def membership(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after ``changes(team_id, user_id, role)``; a null role takes a member out.

    Changes that would leave a team without an owner are not made, all of that team's together.
    """
    both = members.join(changes.select("team_id", "user_id", F.col("role").alias("_role"), F.lit(True).alias("_asked")), ["team_id", "user_id"], "full_outer")
    both = both.withColumn("_new", F.when(F.col("_asked"), F.col("_role")).otherwise(F.col("role")))
    owned = both.groupBy("team_id").agg(F.coalesce(F.bool_or(F.col("_new") == "Owner"), F.lit(False)).alias("_owned"))
    out = both.join(owned, "team_id").withColumn("role", F.when(F.col("_owned"), F.col("_new")).otherwise(F.col("role")))
    return out.where(F.col("role").isNotNull()).select("team_id", "user_id", "role")


def view(entries: DataFrame, name: str | None = None, positions: list[int] | None = None, name_column: str = "name", position_column: str = "position") -> DataFrame:
    """What a board shows: no rejected entries, a name in any case, positions."""
    out = entries.where(F.col("status") != REJECTED)
    if name:
        out = out.where(F.contains(F.lower(name_column), F.lit(name.lower())))
    return out.where(F.col(position_column).isin(positions)) if positions else out
