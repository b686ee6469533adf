"""Exact top-k inner products: vectors by descending length, pruned by residual bounds.

Candidates are cut into tiers of descending norm and the tiers into blocks. A query's k-th best
score against the longest vectors is its first threshold: tiers whose longest vector cannot reach
it (|q| |c| by Cauchy-Schwarz) are never paired with it. Inside a cell of one query block and one
candidate block the vectors are taken by descending norm; a partial product over the leading
directions of an SVD rotation, plus the product of the residual norms, bounds the score, and only
what can reach the threshold gets its exact integer product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.llm import rows

#: Vectors to fit the rotation on, and to draw first thresholds from. They decide speed, never results.
FIT_VECTORS = 4096
SEED_VECTORS = 2048
TIERS = 32
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
LEADING = 16
#: Products below this are exact in double arithmetic.
_EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min
_LONG = pa.list_(pa.float64())


def _scaled(scale: float):
    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, norms = [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(scale * v)
                ids.append(i)
                vectors.append(v)
                norms.append(math.sqrt(float(v @ v)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, _LONG), pa.array(norms, pa.float64()), pa.array([len(v) for v in vectors], pa.int32())], names=["vec_id", "v", "norm", "dim"])

    return scaled


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the limits."""
    top = (np.abs(q).max(initial=0) or 0) * (np.abs(c).max(initial=0) or 0) * max(1, q.shape[1])
    if top < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    out = whole(q).dot(whole(c).T)
    return np.clip(out, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def cell(q_ids, q, floors, c_ids, c, rotation, k: int, leading: int = LEADING, step: int = 512):
    """The k best of ``c`` for each query among those that can reach its floor: (scores, ids), -2^63 where none."""
    order = np.argsort(-np.einsum("ij,ij->i", c, c), kind="stable")
    c, c_ids = c[order], c_ids[order]
    qr, cr = q @ rotation, c @ rotation
    ql, cl = qr[:, :leading], cr[:, :leading]
    q_left, c_left = np.linalg.norm(qr[:, leading:], axis=1), np.linalg.norm(cr[:, leading:], axis=1)
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    scores, ids = np.full((len(q), k), _NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    floors = floors.astype(np.float64).copy()
    for lo in range(0, len(c), step):
        some = slice(lo, lo + step)
        slack = 1e-9 * q_norm * c_norm[lo] + 1e-6
        alive = np.flatnonzero(q_norm * c_norm[lo] + slack >= floors)
        if not len(alive):
            break
        bound = ql[alive] @ cl[some].T + np.outer(q_left[alive], c_left[some]) + slack[alive, None]
        can = (bound >= floors[alive, None]) & (q_ids[alive, None] != c_ids[None, some])
        hit = can.any(axis=1)
        at = alive[hit]
        if not len(at):
            continue
        exact = np.where(can[hit], _products(q[at], c[some]), _NONE)
        names = np.broadcast_to(c_ids[some], exact.shape)
        scores[at], ids[at] = _best(np.hstack([scores[at], exact]), np.hstack([ids[at], np.where(exact == _NONE, np.iinfo(np.int64).max, names)]), k)
        kth = scores[at, k - 1]
        floors[at] = np.where(kth > _NONE, np.maximum(floors[at], kth.astype(np.float64)), floors[at])
    return scores, ids


def _with_floors(seeds: dict, k: int):
    """Each query's k-th best score among the longest vectors of its dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            floors = np.full(batch.num_rows, -np.inf)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                c_ids, c = seeds[int(dim)]
                part = batch.take(pa.array(at))
                q, q_ids = _matrix(part.column("v")), part.column("vec_id").to_numpy()
                if q.shape[1] == 0:
                    continue
                for lo in range(0, len(at), 256):
                    got = np.where(q_ids[lo : lo + 256, None] == c_ids[None, :], _NONE, _products(q[lo : lo + 256], c))
                    if got.shape[1] >= k:
                        kth = np.partition(got, got.shape[1] - k, axis=1)[:, got.shape[1] - k]
                        floors[at[lo : lo + 256]] = np.where(kth > _NONE, kth.astype(np.float64), -np.inf)
            yield batch.append_column("floor", pa.array(floors))

    return add


def _cells(rotations: dict, k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        q, c = _matrix(left.column("v")), _matrix(right.column("v"))
        q_ids, c_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        if q.shape[1] == 0:
            q, c = np.zeros((len(q_ids), 1)), np.zeros((len(c_ids), 1))
        rotation = rotations.get(q.shape[1])
        rotation = np.eye(q.shape[1]) if rotation is None else rotation
        scores, ids = cell(q_ids, q, left.column("floor").to_numpy(), c_ids, c, rotation, k)
        row, col = np.nonzero(scores > _NONE)
        return pa.table([pa.array(q_ids[row]), pa.array(ids[row, col]), pa.array(scores[row, col])], schema=out)

    return run


def top_inner_products(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x).

    Queries are the rows of ``vectors(vec_id, embedding, ...)`` whose id is divisible by
    ``query_every``; candidates are all rows of another id and the same number of components. Rows
    with a null id or vector, or with a null or non-finite component, take no part. Ties go to the
    smaller id. Repeated rows are candidates as often as they are there; a repeated query row
    counts once. Queries without candidates have no rows, and an empty table gives none.
    """
    rows.bounded_batches(vectors.sparkSession)
    vecs = rows.written(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_scaled(scale), "vec_id long, v array<double>, norm double, dim int"))
    spark = vecs.sparkSession
    dims = [r.dim for r in vecs.select("dim").distinct().collect()]
    rotations, seeds, bounds = {}, {}, {}
    for dim in dims:
        same = vecs.where(F.col("dim") == dim)
        fit = same.orderBy(F.xxhash64("vec_id")).limit(FIT_VECTORS).select("v").toArrow()
        m = _matrix(fit.column("v"))
        rotations[dim] = np.linalg.svd(m.T @ m)[0] if dim else np.zeros((0, 0))
        top = same.orderBy(F.desc("norm"), "vec_id").limit(SEED_VECTORS).select("vec_id", "v").toArrow()
        seeds[dim] = top.column("vec_id").to_numpy(), _matrix(top.column("v"))
        cuts = same.agg(F.percentile_approx("norm", [i / TIERS for i in range(TIERS)], 10000)).first()[0]
        bounds[dim] = sorted(set(cuts), reverse=True)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # tier: how many cuts are above the norm; the cuts of all dimensions fit in one bounded literal
    tier = F.lit(0)
    for dim in dims:
        tier = F.when(F.col("dim") == dim, sum((F.when(F.col("norm") < b, 1).otherwise(0) for b in bounds[dim]), F.lit(0))).otherwise(tier)
    vecs = vecs.withColumn("tier", tier)
    sizes = {(r.dim, r.tier): (r.n, r.longest) for r in vecs.groupBy("dim", "tier").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()}
    tiers = spark.createDataFrame([(d, t, int(math.ceil(n / BLOCK_ROWS)), float(m)) for (d, t), (n, m) in sorted(sizes.items())], "dim int, tier int, blocks int, longest double")
    asked = vecs.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"]).select("vec_id", "v", "norm", "dim")
    asked = rows.written(asked.mapInArrow(_with_floors(seeds, k), "vec_id long, v array<double>, norm double, dim int, floor double"))
    query_blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    # longest vectors first: a query meets a tier only if that tier's longest vector can reach its floor
    reach = (F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-6) >= F.col("floor")
    left = asked.join(F.broadcast(tiers), "dim").where(reach).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    left = left.select("dim", "tier", "block", "qb", "vec_id", "v", "floor")
    right = vecs.join(F.broadcast(tiers.drop("longest")), ["dim", "tier"]).withColumn("block", F.expr("cast(pmod(xxhash64(vec_id, 1), blocks) as int)"))
    wanted = asked.join(F.broadcast(tiers), "dim").where(reach).select("dim", "tier", F.col("qb").alias("qc")).distinct()
    right = right.join(rows.small(wanted), ["dim", "tier"]).select("dim", "tier", "block", "qc", "vec_id", "v")
    by = ["dim", "tier", "block"]
    best = left.groupBy(*by, "qb").cogroup(right.groupBy(*by, "qc")).applyInArrow(_cells(rotations, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
