"""What the text operators share: scratch tables, row keys and byte views of Arrow columns."""

from __future__ import annotations

import atexit
import bisect
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many rows, and when the
#: values of its columns without a fixed size were added up and have at most so many bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20

_scratch: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``df`` as ``written`` gives it, and aggregates of its rows that the same query takes along."""
    seen = Observation()
    out = written(df.observe(seen, *(m.alias(k) for k, m in measures.items())))
    return out, seen.get


def counted(df: DataFrame, **measures: Column) -> DataFrame:
    """``df`` as ``written`` gives it, measured for ``small`` by the query that writes it; more measures are in ``_counted``.

    Each query that only counts has a plan and statistics that the driver keeps, so it holds fewer of them.
    """
    loose = _loose(df)
    out, seen = observed(df, rows=F.count(F.lit(1)), bytes=_taken(loose) if loose else F.max(F.lit(0)), **measures)
    out._counted = seen
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for table in tables:
        _delete(table._scratch_path)


def _delete(path: str) -> None:
    spark = _scratch.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_scratch):
        try:
            _delete(path)
        except Exception:  # the JVM has gone: the folder's owner cleans up
            return


def _loose(df: DataFrame) -> list[str]:
    """Columns without a fixed size."""
    return [c for c, kind in df.dtypes if kind.startswith(("string", "binary", "array", "map", "struct"))]


def _taken(loose: list[str]) -> Column:
    return F.sum(F.octet_length(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in loose)))))


def small(df: DataFrame, rows: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """``df`` marked for broadcast if it was measured to be small; otherwise the planner decides.

    ``rows`` is its number of rows, or a bound of it, where that is known. ``of`` is a ``counted`` table that
    ``df`` takes rows and columns from, each at most once: where that is small, ``df`` needs no query of its own.
    """
    known = getattr(df if of is None else of, "_counted", None) if rows is None else None
    loose = _loose(df)
    if known and known["rows"] <= BROADCAST_ROWS and (not loose or (known["bytes"] or 0) <= BROADCAST_BYTES):
        return F.broadcast(df)
    if known and of is None:
        return df
    rows = df.count() if rows is None else rows
    if rows > BROADCAST_ROWS or loose and (df.agg(_taken(loose)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes, so that long texts do not add up in memory.

    It stays set, since the bound has to hold when the frames made here run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores after it, so that no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key() -> list:
    """Two independent 64-bit hashes of the text and its length: the identity of a distinct text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(7), text).alias("k2"),
    ]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and row offsets; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow has kept of them goes back to the system after each."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def is_held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(True))


class Taken:
    """Spans of one text, asked whether any touches a stretch, in the logarithm of their number."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts, self.furthest = [a for a, _ in ordered], list(itertools.accumulate((b for _, b in ordered), max))

    def touches(self, lo: int, hi: int) -> bool:
        before = bisect.bisect_left(self.starts, hi)
        return before > 0 and self.furthest[before - 1] > lo
