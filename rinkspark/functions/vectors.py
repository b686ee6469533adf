"""Vectors as arrays: norms, distances, bitmaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def l1_norm(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: F.abs(x.cast("double"))))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalised(v: Column, norm: str = "l1") -> Column:
    """Components over the norm; all zero where the norm is zero; ``none`` leaves them."""
    if norm == "none":
        return F.transform(v, lambda x: x.cast("double"))
    size = {"l1": l1_norm, "l2": l2_norm}[norm](v)
    return F.transform(v, lambda x: F.when(size == 0, 0.0).otherwise(x.cast("double") / size))


def squared_distance(a: Column, b: Column) -> Column:
    """Differences in single precision, their squares summed in double."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("float") - y.cast("float")).cast("double") * (x.cast("float") - y.cast("float")).cast("double")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two bitmaps held as arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)


def bit_string_words(bits: Column) -> Column:
    """A string of 0 and 1 as 32-bit words, the first character in the lowest bit."""
    n = F.ceil(F.length(bits) / 32)
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.conv(F.reverse(F.substring(bits, i * 32 + 1, F.lit(32))), 2, 10).cast("long"))


def words_bit_string(words: Column, length: Column) -> Column:
    one = F.transform(words, lambda w: F.reverse(F.lpad(F.conv(w.cast("string"), 10, 2), 32, "0")))
    return F.substring(F.array_join(one, ""), F.lit(1), length)


def sign_bits(column: str) -> Column:
    """The signs of a vector column as 64-bit words of 63 components each, the first in the highest bit."""
    bit = "shiftleft(n, 1) | (case when x > 0 then 1L else 0L end)"
    return F.expr(f"transform(sequence(0, (size({column}) - 1) div 63), w -> aggregate(slice({column}, w * 63 + 1, 63), 0L, (n, x) -> {bit}))")


def all_equal(a: Column, b: Column) -> Column:
    """Whether two arrays are alike place by place; arrays of different lengths are not."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda p: p["x"].eqNullSafe(p["y"]))
