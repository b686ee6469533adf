"""References between decoded save files, resolved by joins: names of players, players of line slots, roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What marks an empty slot or no reference.
NOBODY = -1


def resolved(rows: DataFrame, references: dict[str, str], table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with a column for each reference: ``references`` gives its name by that of the id column.

    The table is cut down to the ids that are asked for before it is joined, once a reference. An id that
    the table lacks, a null and ``NOBODY`` stay null; of several values of an id the least counts.
    """
    if clash := set(references.values()) & set(rows.columns):
        raise ValueError(f"there already: {', '.join(sorted(clash))}")
    ids = reduce(DataFrame.unionByName, [rows.select(F.col(c).cast("long").alias("_id")) for c in references]).where(F.col("_id") != NOBODY).distinct()
    known = table.select(F.col(key).cast("long").alias("_id"), F.col(value).alias("_value")).join(ids, "_id", "left_semi")
    known = known.groupBy("_id").agg(F.min("_value").alias("_value"))
    for column, name in references.items():
        wanted = known.select(F.col("_id").alias(f"_{name}"), F.col("_value").alias(name))
        rows = rows.join(wanted, F.col(column).cast("long") == F.col(f"_{name}"), "left").drop(f"_{name}")
    return rows


def slots(lines: DataFrame, key: str, lists: list[str], locks: str | None = None) -> DataFrame:
    """(key, situation, slot, identity[, locked]): a row a slot of each situational list, in the lists' order.

    ``locks`` names an array of lists parallel to ``lists``; a lock that isn't there is null.
    """
    each = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(c).alias("situation"), F.col(c).alias("ids")) for i, c in enumerate(lists)))
    out = lines.select(key, *[locks] * (locks is not None), F.explode(each).alias("_l")).select("*", F.posexplode("_l.ids").alias("slot", "identity"))
    locked = [F.get(F.get(F.col(locks), F.col("_l.n")), F.col("slot")).cast("boolean").alias("locked")] if locks else []
    return out.select(key, "_l.situation", "slot", F.when(F.col("identity") != NOBODY, F.col("identity")).alias("identity"), *locked)


def units(of_slots: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``of_slots`` with the unit that a slot is in and its place there, by the size of a situation's units."""
    size = F.create_map(*(x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))))[F.col("situation")]
    return of_slots.withColumn("unit", F.floor(F.col("slot") / size).cast("int")).withColumn("place", (F.col("slot") % size).cast("int"))
