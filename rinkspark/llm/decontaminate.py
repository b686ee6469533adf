"""Benchmark decontamination with SimHash windows, in DataFrame operations alone.

A window is as many words long as the benchmark item it is held against, or the whole text where that
is shorter. Items and windows get a 64-bit SimHash of their five-word shingles. Multi-index Hamming
blocks (ten of at most seven bits, one wrong bit allowed in a block) find every item of the window's
size within 19 bits, by the pigeonhole principle; the exact similarity of the shingles, weighted by
how often each occurs, decides.

Most texts hold too few of an item's shingles for any window to reach the similarity; one count by text
and item finds those that don't, in one scan of all places of all texts. The rest are read again, equal
texts once. Windows start only at shared shingles: sliding a window right up to its first shared
shingle, or to the end of the text, never lowers its similarity, and no document loses its best window.
Counts of shared shingles and of fingerprint bits are running sums over a text's places, so that a text
and an item cost as many rows as they have words, however long they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.llm import rows

WORDS = 5
SIMILAR = 0.8
RADIUS = 19
#: Blocks of the fingerprint; RADIUS // BLOCKS bits may differ in the best of them.
BLOCKS = 10
#: Shingles of the benchmark up to which their places are found in the scan of the texts itself.
KNOWN_SHINGLES = 1_000_000


def _shingles(words: str, n: int = WORDS) -> str:
    """SQL: hashes of the ``n``-word shingles of an array of words; of all words if there are fewer."""
    many = f"transform(sequence(0, size({words}) - {n}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(n))}))"
    return f"case when size({words}) >= {n} then {many} when size({words}) > 0 then array(xxhash64(array_join({words}, ' '))) else cast(array() as array<bigint>) end"


def _words(text: str = "text") -> str:
    return f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"


def _simhash(hashes: str) -> str:
    """SQL: the 64-bit majority fingerprint of an array of hashes."""
    count = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1L as int))"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> case when 2 * {count} > size({hashes}) then f | shiftleft(1L, b) else f end)"


def _block(i: int, fp: str = "fp") -> str:
    lo, hi = i * 64 // BLOCKS, (i + 1) * 64 // BLOCKS
    return f"cast(shiftrightunsigned({fp}, {lo}) & {(1 << (hi - lo)) - 1}L as int)"


def _item_keys(items: DataFrame) -> DataFrame:
    """(size, block, value, item, fp): each block's value, and that with any one bit changed."""
    widths = [(i + 1) * 64 // BLOCKS - i * 64 // BLOCKS for i in range(BLOCKS)]
    near = [f"transform(array(0, {', '.join(str(1 << b) for b in range(w))}), m -> struct({i} as block, {_block(i)} ^ m as value))" for i, w in enumerate(widths)]
    return items.select("size", "item_id", "fp", F.explode(F.expr(f"concat({', '.join(near)})")).alias("k")).select("size", "k.block", "k.value", "item_id", "fp")


def _made(df: DataFrame, expression: str, name: str) -> DataFrame:
    """``df`` with a column that is computed once: a generator keeps its expression from being inlined."""
    return df.select("*", F.explode(F.array(F.expr(expression))).alias(name))


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with the shingles of its ``text`` in place of it."""
    kept = [c for c in df.columns if c != "text"]
    return _made(_made(df, _words(), "w"), _shingles("w"), "hashes").select(*kept, "hashes")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, hashes, fp) of the items that have words."""
    items = _hashed(benchmark.select("item_id", "text")).where("size(hashes) > 0").distinct()
    return items.select("item_id", F.size("hashes").alias("size"), "hashes", F.expr(_simhash("hashes")).alias("fp"))


#: A text, by two hashes of it: equal texts are worked on once.
_TEXT = ["k1", "k2"]


def _able(share: float) -> Column:
    """How many of a window's shingles must be the item's for the similarity; ``m`` is the window's size."""
    return share / (1 + share) * (F.col("size") + F.col("m")) - 1e-6


def _pairs(docs: DataFrame, shingles: DataFrame, n_shingles: int, similar: float) -> DataFrame:
    """(id, k1, k2, n, i): documents with enough of an item's shingles, wherever they are."""
    keyed = _hashed(docs.select(F.col("doc_id").alias("id"), *rows.text_key(), "text")).select("id", *_TEXT, F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    sizes = shingles.select("h", "i", "size")
    both = keyed.join(F.broadcast(sizes) if n_shingles <= KNOWN_SHINGLES else sizes, "h")
    counted = both.groupBy("id", *_TEXT, "n", "i", "size").agg(F.count(F.lit(1)).alias("c"))
    m = F.least("n", "size")
    # a text shorter than the item is one clipped window; under a part of it none reaches the similarity
    return counted.withColumn("m", m).where((F.col("c") >= _able(similar)) & (F.col("m") / F.col("size") >= similar)).select("id", *_TEXT, "n", "i")


def _windows(places: DataFrame, pairs: DataFrame, shingles: DataFrame, similar: float) -> DataFrame:
    """(k1, k2, i, size, m, start, both): windows that start at shared shingles and hold enough of them.

    ``both`` is the weight that window and item share: of the places with one shingle a window counts as
    many as the item has. A place so counts in the windows that hold it but not the place as many
    occurrences before, which is one range of starts, and running sums over the ends of all ranges give
    every start its count.
    """
    pair = pairs.select(*_TEXT, "n", "i").distinct()
    at = places.join(rows.small(shingles), "h").join(rows.small(pair, of=pairs), [*_TEXT, "i"]).select(*_TEXT, "i", "n", "size", "weight", "h", "p")
    each = at.groupBy(*_TEXT, "i", "n", "size", "weight", "h").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    each = each.select(*_TEXT, "i", "n", "size", F.posexplode("ps").alias("x", "p"), "ps", "weight")
    each = each.withColumn("q", F.when(F.col("x") >= F.col("weight"), F.expr("ps[x - weight]")).otherwise(-1)).drop("ps", "x", "weight")
    clip = lambda c: F.greatest(F.lit(0), c)
    event = lambda start, both, count, asked: F.struct(start.alias("start"), F.lit(both).alias("db"), F.lit(count).alias("dc"), F.lit(asked).alias("asked"))
    first = F.col("p") - F.col("size") + 1
    ends = [event(clip(F.greatest(F.col("q") + 1, first)), 1, 0, False), event(clip(first), 0, 1, False), event(F.col("p") + 1, -1, -1, False)]
    ends.append(event(clip(F.least(F.col("p"), F.col("n") - F.col("size"))), 0, 0, True))
    moves = each.select(*_TEXT, "i", "n", "size", F.explode(F.array(*ends)).alias("e")).select(*_TEXT, "i", "n", "size", "e.*")
    # as many rows a start as it has kinds of ends, before they are put in order
    moves = moves.groupBy(*_TEXT, "i", "n", "size", "start").agg(F.sum("db").alias("db"), F.sum("dc").alias("dc"), F.bool_or("asked").alias("asked"))
    so_far = Window.partitionBy(*_TEXT, "i").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    run = moves.withColumn("both", F.sum("db").over(so_far)).withColumn("count", F.sum("dc").over(so_far)).where("asked")
    run = run.withColumn("m", F.least("n", "size"))
    return run.where(F.col("count") >= _able(similar)).select(*_TEXT, "i", "size", "m", "start", "both")


def _fingerprints(places: DataFrame, windows: DataFrame, longest: int) -> DataFrame:
    """(k1, k2, start, size, m, fp): the majority fingerprint of each window, by running counts of all bits.

    Several counts share a number, each as wide as the longest text needs, so that none runs over; a
    window's counts are the difference between its ends.
    """
    wide, each = next((w, 63 // w) for w in (15, 21, 31) if longest < 1 << w)
    parts = -(-64 // each)
    spread = F.expr(f"transform(sequence(0, {parts - 1}), k -> aggregate(sequence(0, {each - 1}), 0L, (a, l) -> a + case when k * {each} + l < 64 then shiftleft(shiftrightunsigned(h, k * {each} + l) & 1L, l * {wide}) else 0L end))")
    ends = windows.select(*_TEXT, F.explode(F.array("start", F.col("start") + F.col("m"))).alias("at")).distinct()
    steps = places.join(rows.small(windows.select(*_TEXT).distinct(), of=windows), _TEXT, "left_semi").select(*_TEXT, (F.col("p") + 1).alias("at"), spread.alias("c"), F.lit(False).alias("asked"))
    every = steps.unionByName(ends.select(*_TEXT, "at", F.lit(None).cast("array<bigint>").alias("c"), F.lit(True).alias("asked")))
    so_far = Window.partitionBy(*_TEXT).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    sums = every.select(*_TEXT, "at", "asked", F.array(*(F.coalesce(F.sum(F.get("c", F.lit(k))).over(so_far), F.lit(0)) for k in range(parts))).alias("sums")).where("asked").drop("asked")
    begin = windows.select(*_TEXT, "start", "size", "m").distinct().join(sums.withColumnRenamed("at", "start").withColumnRenamed("sums", "b"), [*_TEXT, "start"])
    both = begin.withColumn("at", F.col("start") + F.col("m")).join(sums.withColumnRenamed("sums", "e"), [*_TEXT, "at"])
    both = both.select(*_TEXT, "start", "size", "m", F.zip_with("e", "b", lambda x, y: x - y).alias("d"))
    fp = f"aggregate(sequence(0, 63), 0L, (f, j) -> case when 2 * (shiftrightunsigned(d[cast(j div {each} as int)], cast(j % {each} as int) * {wide}) & {(1 << wide) - 1}L) > m then f | shiftleft(1L, j) else f end)"
    return both.select(*_TEXT, "start", "size", "m", F.expr(fp).alias("fp"))


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_windows): items of which a document holds a near copy.

    Takes ``docs(doc_id, text, ...)`` and ``benchmark(item_id, text, ...)``. ``similarity`` is the
    best window's, ``start`` the first word (from 0) of the first such window, ``n_windows`` how many
    windows pass. Words are runs of letters and digits, lower-cased. Null and empty texts have none;
    texts with fewer words than the item are one window of their own size, held against the whole
    item; long texts are one array of words. Repeated rows give one result an id; a null id is a value like any other. Each
    item is a row of its own, whatever others reach; items of one id are held together. Either table may be empty.
    """
    items, seen = rows.observed(benchmark_items(benchmark).withColumn("i", F.monotonically_increasing_id()), rows=F.count(F.lit(1)))
    n_items = seen["rows"]
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start int, n_windows long")
    if not n_items:
        return empty
    shingles = rows.counted(items.select("i", "size", F.explode("hashes").alias("h")).groupBy("i", "size", "h").agg(F.count(F.lit(1)).cast("int").alias("weight")))
    pairs = rows.counted(_pairs(docs, shingles, shingles._counted["rows"], similar), longest=F.max("n"))
    longest = pairs._counted["longest"] or 0
    # the texts that can hold an item are read again, each once
    texts = rows.small(pairs.select(*_TEXT).distinct(), of=pairs)
    again = docs.select(*rows.text_key(), "text").join(texts, _TEXT, "left_semi").groupBy(*_TEXT).agg(F.first("text").alias("text"))
    places = rows.written(_hashed(again).select(*_TEXT, F.posexplode("hashes").alias("p", "h")))
    windows = rows.counted(_windows(places, pairs, shingles, similar))
    marked = rows.written(_fingerprints(places, windows, longest))
    blocks = ", ".join(f"struct({i} as block, {_block(i)} as value)" for i in range(BLOCKS))
    probes = marked.select("*", F.explode(F.expr(f"array({blocks})")).alias("k")).select(*_TEXT, "start", "size", "fp", "k.block", "k.value")
    keys = _item_keys(items.withColumn("item_id", F.col("i"))).withColumnRenamed("fp", "item_fp").withColumnRenamed("item_id", "i")
    near = probes.join(rows.small(keys, n_items * 72), ["size", "block", "value"]).where(f"bit_count(fp ^ item_fp) <= {RADIUS}")
    near = near.select(*_TEXT, "start", "i").distinct()
    checked = near.join(windows, [*_TEXT, "start", "i"]).withColumn("similarity", F.col("both") / (F.col("size") + F.col("m") - F.col("both"))).where(F.col("similarity") >= similar)
    found = checked.join(rows.small(items.select("i", "item_id"), n_items), "i").join(pairs.select("id", *_TEXT, "i"), [*_TEXT, "i"])
    best = F.max_by("start", F.struct("similarity", -F.col("start")))
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("similarity").alias("similarity"), best.alias("start"), F.countDistinct("start").alias("n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` without the documents that hold a near copy of an item; rows without an id stay."""
    dirty = rows.counted(leaks(docs, benchmark, similar).select("doc_id").distinct())
    return docs.join(rows.small(dirty), "doc_id", "left_anti").select(*docs.columns)
