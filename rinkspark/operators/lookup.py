"""Lookups by ids and names, with what was not found and what was ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_INPUTS = 200


def requests(spark, ids: list[int], names: list[str]) -> DataFrame:
    """(ordinal, id, name): ids first, then trimmed names; blanks and repeats are dropped, 200 at most."""
    names = [n.strip() for n in names if n and n.strip()]
    every = [(i, None) for i in dict.fromkeys(ids)] + [(None, n) for n in dict.fromkeys(names)]
    if len(every) > MOST_INPUTS:
        raise ValueError(f"more than {MOST_INPUTS} ids and names")
    return spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(every)], "ordinal int, id long, name string")


def resolve(wanted: DataFrame, table: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """Each request with ``outcome`` found, ambiguous or not_found, and the ids that it names.

    Ids match exactly, names in any case. The requests are few by contract and are broadcast; the
    table is read once.
    """
    few = F.broadcast(wanted)
    hit = table.select(F.col(id_column).cast("long").alias("_id"), F.lower(name_column).alias("_name"))
    by_id = hit.join(few.where("id is not null"), F.col("_id") == F.col("id")).select("ordinal", "_id")
    by_name = hit.join(few.where("id is null"), F.col("_name") == F.lower("name")).select("ordinal", "_id")
    hits = by_id.unionByName(by_name).groupBy("ordinal").agg(F.sort_array(F.collect_set("_id")).alias("ids"))
    out = wanted.join(hits, "ordinal", "left").withColumn("ids", F.coalesce("ids", F.expr("cast(array() as array<bigint>)")))
    outcome = F.when(F.size("ids") == 0, "not_found").when(F.size("ids") == 1, "found").otherwise("ambiguous")
    return out.select("ordinal", "id", "name", outcome.alias("outcome"), "ids")


def found_ids(resolved: DataFrame) -> DataFrame:
    """(ordinal, id) of what was found, each id once, in order of the first request for it."""
    return resolved.where("outcome = 'found'").select(F.get("ids", F.lit(0)).alias("id"), "ordinal").groupBy("id").agg(F.min("ordinal").alias("ordinal"))


def by_ids(table: DataFrame, id_column: str, ids: list[int], order: list[str], most: int = 500) -> DataFrame:
    """Rows of distinct ids, in ``order``; unknown ids are left out, more than ``most`` are an error."""
    ids = list(dict.fromkeys(ids))
    if len(ids) > most:
        raise ValueError(f"more than {most} ids")
    return table.where(F.col(id_column).isin(ids)).orderBy(*order)


def by_many_ids(table: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """Rows of any number of ids, held in a frame ``ids(id)``: one join, where a list would be asked for in chunks."""
    return table.join(ids.select(F.col("id").alias("_id")).distinct(), F.col(id_column) == F.col("_id"), "left_semi")


def union_first_seen(first: DataFrame, second: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Distinct keys of both, in the order in which they came, all of the first before the second."""
    both = first.select(key, F.lit(0).alias("_side"), ordinal).unionByName(second.select(key, F.lit(1).alias("_side"), ordinal))
    return both.groupBy(key).agg(F.min(F.struct("_side", ordinal)).alias("_at")).orderBy("_at").select(key)


def missing(wanted: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(table.select(*keys), keys, "left_anti")


def already(wanted: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(table.select(*keys), keys, "left_semi")
