"""Vectors compressed to one code a part: weighted Lloyd rounds over each position's distinct parts.

Components become integers, and a vector is cut into equal parts. Equal parts of one position are one
row with a weight, so a value that a third of all vectors hold costs one row, and every round works on
distinct rows alone: each goes to its nearest entry of the position's codebook, and weighted sums by
entry, at most ``ENTRIES`` a position and task, make the next codebook. After the last round distinct
rows keep their entry and squared distance, and vectors get theirs by an equality join on the part.
Parts that more than one in ``HEAVY`` of all rows have are few by that count, so they are joined by
broadcast; every other key has a bounded number of rows in the shuffle. Labels' errors come back to
the vectors in the same way.

Sums are of whole numbers, so results don't depend on the order of rows or tasks.

Defined cases: vectors that are null or hold a null or a number that isn't finite are dropped. Vectors
of each length have codebooks of their own; a length that ``PARTS`` doesn't divide is filled up with
zeros at the end, which change no distance. Codebooks start from the smallest ids, rows of one id in
order of their components, null ids last; with fewer vectors than entries, there are as many entries
as vectors. Integers are held to 2^24 either way. Repeated rows and ids are vectors of their own, other
columns are not read, and an empty table gives no rows. The driver and each task hold the codebooks:
``ENTRIES`` vectors of each length that occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm import rows

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Largest integer component; squared distances of vectors of any usual length then fit 64 bits.
LARGEST = 1 << 24
#: A key is heavy if more than one in so many rows have it.
HEAVY = 1024
#: Distinct parts whose distances to all entries a task holds at once.
BLOCK = 8192


def integers(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, q): the usable vectors as integers, filled up to equal parts."""
    x = F.col(column).cast("array<double>")
    usable = F.col(column).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    filled = F.concat(held, F.array_repeat(F.lit(0), F.pmod(-F.size(held), F.lit(parts))))
    label = F.col("label") if "label" in {c.lower() for c in vectors.columns} else F.lit(None).cast("int")
    return vectors.where(usable).select("vec_id", label.alias("label"), filled.alias("q"))


def cut(kept: DataFrame, parts: int = PARTS) -> DataFrame:
    """A row a part: ``kept`` with (dim, pos, part) in place of its vector."""
    width = (F.size("q") / parts).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("q", i * width + 1, width))
    return kept.select(*(c for c in kept.columns if c != "q"), F.size("q").alias("dim"), F.posexplode(each).alias("pos", "part"))


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> dict[int, np.ndarray]:
    """By length: the smallest ids' parts as (position, entry, component)."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "q")  # each task passes on its first ones alone
    found = kept.withColumn("dim", F.size("q")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= entries)
    by: dict[int, list] = {}
    for r in sorted(found.select("dim", "n", "q").collect(), key=lambda r: r.n):
        by.setdefault(r.dim, []).append(r.q)
    return {d: np.array(v, np.int64).reshape(len(v), parts, d // parts).transpose(1, 0, 2).copy() for d, v in by.items()}


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries of each row of ``values``, and its squared distance, in whole numbers."""
    code, error = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for lo in range(0, len(values), BLOCK):
        some = values[lo : lo + BLOCK]
        apart = np.zeros((len(some), len(book)), np.int64)
        for j in range(values.shape[1]):
            apart += (some[:, j, None] - book[None, :, j]) ** 2
        code[lo : lo + BLOCK] = best = apart.argmin(axis=1)
        error[lo : lo + BLOCK] = apart[np.arange(len(some)), best]
    return code, error


def _positions(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(dim, position, its rows in the batch, their values)."""
    dim, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "pos"))
    column = batch.column(batch.schema.get_field_index("part"))
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    if not len(dim):
        return
    order = np.lexsort((pos, dim))
    starts = np.flatnonzero(np.diff(dim[order], prepend=-1) | np.diff(pos[order], prepend=-1))
    for own in np.split(order, starts[1:]):
        width = int(at[own[0] + 1] - at[own[0]])
        yield int(dim[own[0]]), int(pos[own[0]]), own, flat[at[own][:, None] + np.arange(width)]


def _sums(books: dict[int, np.ndarray]):
    """Weighted sums and weights by entry, of all that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            weight = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim, pos, own, values in _positions(batch):
                book = books[dim][pos]
                code, _ = nearest(values, book)
                total = found.setdefault((dim, pos), np.zeros((len(book), values.shape[1] + 1), np.int64))
                np.add.at(total, code, np.column_stack([values, np.ones(len(values), np.int64)]) * weight[own, None])
        for (dim, pos), total in found.items():
            used = np.flatnonzero(total[:, -1])
            entry, j = np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), len(used))
            ends = (np.full(len(entry), x, np.int32) for x in (dim, pos))
            columns = [*ends, entry.astype(np.int32), j.astype(np.int32), total[used].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "pos", "entry", "j", "s"])

    return run


def lloyd(distinct: DataFrame, books: dict[int, np.ndarray], rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """The codebooks after so many rounds over ``distinct(dim, pos, part, n)``; entries without parts stay."""
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books), "dim int, pos int, entry int, j int, s long")
        books = {d: b.copy() for d, b in books.items()}
        by: dict[tuple[int, int, int], dict[int, int]] = {}
        for r in sums.groupBy("dim", "pos", "entry", "j").agg(F.sum("s").alias("s")).collect():  # as many rows as the codebooks have numbers
            by.setdefault((r.dim, r.pos, r.entry), {})[r.j] = r.s
        for (dim, pos, entry), total in by.items():
            width = len(total) - 1
            books[dim][pos, entry] = [total[j] // total[width] for j in range(width)]
    return books


def assigned(distinct: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """``distinct`` with (entry, error): the nearest entry of each distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for dim, pos, own, values in _positions(batch):
                code[own], error[own] = nearest(values, books[dim][pos])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], [*batch.schema.names, "entry", "error"])

    return distinct.mapInArrow(run, T.StructType([*distinct.schema.fields, T.StructField("entry", T.IntegerType()), T.StructField("error", T.LongType())]))


def looked_up(df: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``df`` joined to ``found``, which has one row for each of its keys and in ``n`` how many rows of ``df`` have it.

    Nulls are keys like others. Fewer than ``HEAVY`` keys can have more than one in ``HEAVY`` of
    ``total`` rows; these are broadcast. The others are shuffled, each with no more rows than that.
    """
    most, values = max(1, total // HEAVY), [c for c in found.columns if c not in (*keys, "n")]
    named = found.select(*(F.col(k).alias(f"_{k}") for k in keys), *values, (F.col("n") > most).alias("_heavy"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    heavy = named.where("_heavy")
    often = df.join(F.broadcast(heavy), same).select(*df.columns, *values)
    seldom = df.join(F.broadcast(heavy.select(*(f"_{k}" for k in keys))), same, "left_anti")
    return often.unionByName(seldom.join(named.where("not _heavy"), same).select(*df.columns, *values))


def compress(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """((row, vec_id, label, dim, codes, error), codebooks by length): every usable vector's entries by position, and its squared error."""
    kept = rows.written(integers(vectors, column, scale, parts).withColumn("row", F.monotonically_increasing_id()))
    each = cut(kept, parts)
    distinct = rows.written(each.groupBy("dim", "pos", "part").agg(F.count(F.lit(1)).alias("n")))
    books = lloyd(distinct, first_codebooks(kept, parts, entries), rounds)
    coded = rows.written(assigned(distinct, books))
    total = kept.count() * parts
    back = looked_up(each.select("row", "vec_id", "label", "dim", "pos", "part"), coded, ["dim", "pos", "part"], total)
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"])
    return back.groupBy("row", "vec_id", "label", "dim").agg(codes.alias("codes"), F.sum("error").alias("error")), books


def decompress(compressed: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """``compressed`` with ``q``: the integers that its codes stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, codes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("dim", "codes"))
            q = [[int(x) for p, c in enumerate(code) for x in books[d][p, c]] for d, code in zip(dims, codes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.list_(pa.int32()))], [*batch.schema.names, "q"])

    return compressed.mapInArrow(run, T.StructType([*compressed.schema.fields, T.StructField("q", T.ArrayType(T.IntegerType()))]))


def codebooks_digest(books: dict[int, np.ndarray]) -> str:
    """SHA-256 of all components in order of length, position, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for d in sorted(books) for x in books[d].ravel()).encode()).hexdigest()


def digests(compressed: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of what ``compress`` gives."""
    done = rows.written(compressed)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    labels = rows.written(done.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")))
    out = looked_up(done.select("vec_id", "label", code.alias("code"), "error"), labels, ["label"], done.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
