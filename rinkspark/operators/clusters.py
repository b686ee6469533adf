"""Clusters of players by stat vector: k-means, centroids, and medoids as real rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.vectors import squared_distance


def feature_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns whose name starts with ``prefix``, in the table's order and case."""
    return [c for c in df.columns if c.startswith(prefix)]


def members(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with any of the features."""
    return df.where(F.coalesce(*[F.col(f"`{f}`").cast("string") for f in features]).isNotNull())


def vectors(df: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``features`` as an array of floats, rows left out because one is not a number)."""
    numbers = [F.col(f"`{f}`").cast("string").try_cast("float") for f in features]
    complete = reduce(lambda a, b: a & b, [n.isNotNull() for n in numbers])
    return df.where(complete).withColumn("features", F.array(*numbers)), df.where(~complete)


def clustered(df: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """Adds ``cluster``, from 1, by k-means over the array column ``features``."""
    with_vector = df.withColumn("_v", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    trainer = KMeans(k=k, featuresCol="_v", predictionCol="_p", **({} if seed is None else {"seed": seed}))
    return trainer.fit(with_vector).transform(with_vector).withColumn("cluster", F.col("_p") + 1).drop("_v", "_p")


#: Features are whole numbers of this part of one while clusters are made, so that sums are exact in any order.
GRID = 1 << 16
#: Rounds at most; clusters that no longer change end earlier.
ROUNDS = 20


def lloyd(df: DataFrame, k: int, key: str, seed: int = 0, rounds: int = ROUNDS, column: str = "features") -> DataFrame:
    """Adds ``cluster``, from 1, by Lloyd's rounds from ``k`` rows of the table, the same on every run and machine.

    It begins with the rows whose MD5 of ``key:seed`` is least, in that order. A round gives each row the
    nearest centre, of equals the first, and moves each centre to its rows' mean, rounded down to the
    grid; centres without rows stay. Only sums by cluster leave the tasks, and k centres come to the
    driver. All rows have as many numbers in ``column``, none of them null.
    """
    grid = df.withColumn("_g", F.transform(column, lambda x: F.floor(x.cast("double") * GRID)))
    begin = grid.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(k)
    centres = [list(r._g) for r in begin.select("_g").collect()]
    if not centres:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    for _ in range(rounds):
        near = grid.select(_nearest(centres).alias("c"), "_g")
        sums = near.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("_g")[i]) for i in range(len(centres[0]))]).alias("s")).collect()
        moved = list(centres)
        for r in sums:
            moved[r.c] = [x // r.n for x in r.s]
        if moved == centres:
            break
        centres = moved
    return grid.withColumn("cluster", _nearest(centres) + 1).drop("_g")


def _nearest(centres: list[list[int]]) -> Column:
    """The number of the nearest centre to ``_g``, of equals the first."""
    given = F.array(*[F.array(*[F.lit(x).cast("long") for x in c]) for c in centres])
    apart = F.transform(given, lambda c, i: F.struct(F.aggregate(F.zip_with("_g", c, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x).alias("d"), i.alias("i")))
    return F.array_min(apart)["i"]


def centroids(df: DataFrame, size: int, cluster: str = "cluster") -> DataFrame:
    """(cluster, members, centroid): mean features of every cluster."""
    mean = F.array(*[F.avg(F.col("features")[i].cast("double")).cast("float") for i in range(size)])
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"), mean.alias("centroid"))


def medoids(df: DataFrame, size: int, key: str, k: int | None = None, cluster: str = "cluster") -> DataFrame:
    """(cluster, members, centroid, medoid, distance): the member nearest each centroid, ties to ``key``.

    With ``k``, clusters without members have 0 members and no medoid. The centroids are k rows.
    """
    centres = centroids(df, size, cluster)
    near = df.join(F.broadcast(centres), cluster).withColumn("distance", squared_distance(F.col("features"), F.col("centroid")))
    best = near.groupBy(cluster).agg(F.min_by(F.struct(F.col(key).alias("medoid"), "distance"), F.struct("distance", key)).alias("_b"))
    out = centres.join(best, cluster).select(cluster, "members", "centroid", "_b.medoid", "_b.distance")
    if k is None:
        return out
    every = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias(cluster))
    return every.join(out, cluster, "left").withColumn("members", F.coalesce("members", F.lit(0)))
