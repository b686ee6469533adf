"""Connected components of a graph held in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node ``u`` to its smaller node ``v``."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, written, and with it a count and a sum that tell them from others."""
    return rows.observed(edges, n=F.count(F.lit(1)), digest=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def _stars(edges: DataFrame) -> bool:
    """Whether no node is both above and below, and none is above in two edges: all edges lead to roots then."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the least node it can reach.

    Self loops, repeated edges and an empty table are fine; null ends are not edges. Each round is
    written to the shared folder; only a count and a sum come to the driver.
    """
    now, seen = _written(_downward(edges.where("u is not null and v is not null")))
    while seen["n"] and not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, digest = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        rows.dropped(now)
        now = after
        if digest == seen:
            break
        seen = digest
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
