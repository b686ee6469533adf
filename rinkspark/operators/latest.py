"""First and last rows of groups, timelines and their alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each key's values in its last row by ``order``: one shuffle of partial results, no join."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(best).select(*keys, "_v.*")


def earliest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(best).select(*keys, "_v.*")


def nth_of(keys: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def with_recreate(df: DataFrame, owner: str, created: str, key: str) -> DataFrame:
    """Adds ``recreate``: whether the owner has an earlier row (by creation, then key).

    Owners' first rows are partial aggregates joined back, so no task gathers all rows of one owner.
    """
    first = df.groupBy(F.col(owner).alias("_owner")).agg(F.min(F.struct(F.col(created).alias("created"), F.col(key).alias("key"))).alias("_first"))
    own = F.struct(F.col(created).alias("created"), F.col(key).alias("key"))
    return df.join(first, F.col(owner).eqNullSafe(F.col("_owner"))).withColumn("recreate", own > F.col("_first")).drop("_owner", "_first")


def with_value(df: DataFrame, values: DataFrame, keys: list[str], value: str, default=0) -> DataFrame:
    """``df`` with a value looked up by key, the default where there is none."""
    return df.join(values.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row a key, the last of the input."""
    rest = [c for c in df.columns if c not in keys]
    return latest(df, keys, [ordinal], rest).select(*df.columns)


def intervals(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds ``until``: a row holds from ``at`` to the next row's, the last has none."""
    return df.withColumn("until", F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def value_at(df: DataFrame, keys: list[str], at: str, moment: Column) -> DataFrame:
    """The rows that hold at ``moment`` in every key's timeline."""
    return intervals(df, keys, at).where((F.col(at) <= moment) & (F.col("until").isNull() | (moment < F.col("until")))).drop("until")


def aligned(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Shifts every timeline so that its first point falls on the earliest of all.

    The earliest is a one-row aggregate, so no window gathers the whole table.
    """
    first = df.groupBy(*keys).agg(F.min(at).alias("_first"))
    earliest_ = first.agg(F.min("_first").alias("_zero"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    moved = F.timestamp_micros(seconds("_zero") + seconds(at) - seconds("_first")).cast(df.schema[at].dataType)
    return df.join(first, keys).join(F.broadcast(earliest_)).withColumn("aligned", moved).drop("_first", "_zero")


def longest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows the longest of the keys' series has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("longest"))


def counter(df: DataFrame, keys: list[str], order: list[str], name: str = "games_played") -> DataFrame:
    return df.withColumn(name, nth_of(keys, order))
