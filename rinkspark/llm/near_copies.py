"""Near copies of whole texts: shingle sets of Jaccard similarity 0.8 or more, by SimHash and, beyond its radius, MinHash.

A text's set holds the hashes of its five-word shingles. Fingerprints of the shingles within two bits
are linked by deletion-variant signatures (``simhash_dedup``); what meets is verified by the exact
similarity of the sets. Texts of similarity 0.8 differ in about ten of 64 bits, further than
one-wildcard segments can search: by the pigeonhole principle a radius of 20 takes eleven segments
of six bits, which any two texts share. So what two bits leave apart meets in MinHash bands: texts
that agree on all ROWS minima of one of BANDS bands are verified in the same way. A pair of
similarity s meets in no band with probability (1 - s^ROWS)^BANDS: below 1e-9 at 0.8, and less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import hashing, rows, simhash_dedup
from rinkspark.llm.components import components

SEED = 42
WORDS = 5
SIMILAR = 0.8
BANDS = 40
ROWS = 4
#: Bytes of text handled at once.
SLICE = 1 << 18
#: Buckets of a set's histogram, which bounds how much two sets can share.
BAGS = 128
#: Members of a band's value up to which all its pairs are verified at once; beyond it stars come first.
CROWD = 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of texts one after another, where each text's begin, and a hash of each text's words.

    Words are runs of bytes between ASCII white space, ASCII letters lower-cased. A text of fewer
    words is one shingle; one without words has no shingle and hash zero.
    """
    data, offsets = hashing.apart(data, offsets)
    data = hashing.LOWER[data]
    lo, hi = hashing.between_gaps(data)
    first = np.searchsorted(lo, offsets)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(1, n_words - words + 1), 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    node = np.zeros(len(n), np.uint64)
    if not len(lo):
        return np.zeros(0, np.uint64), begin, node
    word = hashing.Prefixes(data).of(lo, hi)
    some = n_words > 0
    place = (np.arange(len(lo)) - np.repeat(first[:-1], n_words)).astype(np.uint64)
    node[some] = hashing.mixed(np.add.reduceat(hashing.mixed(word + place * _ODD), first[:-1][some]))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    end = np.repeat(first[1:], n)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        here = at + k
        out = np.where(here < end, out * _ODD + word[np.minimum(here, len(word) - 1)], out)
    return hashing.mixed(out), begin, node


def _band_keys(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of BANDS keys for each text that has shingles."""
    starts = begin[:-1][np.diff(begin) > 0]
    out = np.zeros((len(starts), BANDS), np.uint64)
    if len(starts):
        short = hashes.astype(np.uint32)
        for i, factor in enumerate(_FACTORS):
            x = short * factor
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            b = i // ROWS
            out[:, b] = hashing.mixed(out[:, b] * _ODD + np.minimum.reduceat(x, starts) + np.uint64(b + 1))
    return out


def _fingerprints(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each text that has shingles: a bit is set if over half of them have it."""
    starts = begin[:-1][np.diff(begin) > 0]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.add.reduceat(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)
    size = np.diff(np.append(starts, begin[-1]))
    return np.packbits(2 * sums > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _slices(batch: pa.RecordBatch, words: int) -> Iterator[tuple]:
    data, offsets = rows.utf8(batch.column("text"))
    for lo, hi in rows.pieces(offsets, SLICE):
        yield lo, hi, *shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            for lo, hi, hashes, begin, node in _slices(batch, words):
                fp = np.zeros(hi - lo, np.uint64)
                fp[np.diff(begin) > 0] = _fingerprints(hashes, begin)
                keys = _lists(_band_keys(hashes, begin).ravel(), np.concatenate([[0], np.cumsum(np.diff(begin) > 0)]) * BANDS)
                ids = batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), keys], names=["doc_id", "node", "fp", "keys"])

    return find


def _sets(words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            for lo, hi, hashes, begin, node in _slices(batch, words):
                owner = np.repeat(np.arange(hi - lo), np.diff(begin))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                kept = np.ones(len(hashes), bool)
                kept[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                begin = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=hi - lo))])
                bags = np.bincount(owner[kept] * BAGS + (hashes[kept] % np.uint64(BAGS)).astype(np.int64), minlength=(hi - lo) * BAGS)
                # one byte a bucket keeps the rows of the joins short; a set that needs more has no histogram and is bounded by its size alone
                large = bags.reshape(-1, BAGS).max(axis=1) > 127
                bags = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BAGS), pa.array(np.minimum(bags, 127).astype(np.int8)), mask=pa.array(large))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), _lists(hashes[kept], begin), bags], names=["node", "set", "bag"])

    return find


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least this Jaccard similarity; sizes nu and nv that pairs bring along have been compared."""
    pairs = pairs.distinct()
    if "nu" not in pairs.columns:
        sizes = sets.select("node", "size")
        pairs = pairs.join(sizes.select(F.col("node").alias("u"), F.col("size").alias("nu")), "u")
        pairs = pairs.join(sizes.select(F.col("node").alias("v"), F.col("size").alias("nv")), "v").where(F.least("nu", "nv") / F.greatest("nu", "nv") >= similar)
    pairs = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.where(both / (F.col("nu") + F.col("nv") - both) >= similar).select("u", "v")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (u, v, nu, nv) of ``nodes(node, root)`` with other roots: all that are similar, and few others.

    With every set in one order, rare shingles first, similar sets share one of the first
    size - ceil(similar size) + 1 of each. A pair counts at the first that it shares, and only if what
    comes after it in both sets can still make them similar, and the sets' histograms as well: two sets
    share no more than the lesser counts of all buckets.
    """
    each = nodes.join(sets, "node").select("node", "root", "size", F.explode("set").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    order = each.join(often, "h").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("all"))
    head = f"transform(slice(all, 1, cast(size - ceil({similar}D * size - 1e-9D) + 1 as int)), x -> x.h)"
    head = order.select("node", "root", "size", F.expr(head).alias("head"))
    head = rows.written(head.select("*", F.posexplode("head").alias("at", "h")))
    # a shingle whose sets are all of one root tells nothing
    across = rows.counted(head.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h"))
    head = head.join(rows.small(across), "h").join(sets.select("node", "bag"), "node")
    other = head.select("h", F.col("node").alias("v"), F.col("root").alias("r"), F.col("size").alias("n"), F.col("head").alias("heads"), F.col("at").alias("place"), F.col("bag").alias("bags"))
    pairs = head.join(other, "h").where("node < v and root <> r").where(F.least("size", "n") / F.greatest("size", "n") >= similar)
    pairs = pairs.where(f"least(size - at, n - place) >= {similar / (1 + similar)}D * (size + n) - 1e-6D").where("get(array_intersect(head, heads), 0) = h")
    pairs = pairs.where(f"coalesce(aggregate(zip_with(bag, bags, (a, b) -> least(a, b)), 0, (s, x) -> s + x), size + n) >= {similar / (1 + similar)}D * (size + n) - 1e-6D")
    return pairs.select(F.col("node").alias("u"), "v", F.col("size").alias("nu"), F.col("n").alias("nv"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``nodes(node, fp)`` to verify: representatives of fingerprints within two bits, and each node with its own.

    Of a crowded variant the members meet the least one alone: the bands find what that leaves apart.
    """
    least = rows.written(nodes.groupBy("fp").agg(F.min("node").alias("u")))
    own = nodes.join(least, "fp").where("node <> u").select("u", F.col("node").alias("v"))
    near = simhash_dedup.links(least.select("fp"), whole=False).select(F.col("u").alias("fp"), F.col("v").alias("other"))
    near = near.join(least, "fp").join(least.select(F.col("fp").alias("other"), F.col("u").alias("v")), "other")
    return own.unionByName(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def links(docs: DataFrame, signed: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """Edges (u, v) that connect what chains of similar pairs connect, for ``signed(node, fp, keys)`` of distinct nodes.

    Fingerprints link first. Of what they leave in different components, all pairs of a band's value
    of few members are verified. In a crowded value every member is held against one; of what that
    leaves in different components, all similar pairs are found by the rarest shingles of each, so no
    link between components is lost.
    """
    keyed = signed.select("node", F.explode("keys").alias("key"))
    met = rows.counted(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = rows.written(keyed.join(rows.small(met), "key"))
    close = rows.written(_by_fingerprint(signed.select("node", "fp")).distinct())
    needed = members.select("node").union(close.select("u")).union(close.select("v")).distinct()
    needed = rows.counted(needed)
    rows.bounded_batches(docs.sparkSession)
    sets = docs.select("text").mapInArrow(_sets(words), "node long, set array<long>, bag array<tinyint>").join(rows.small(needed), "node").dropDuplicates(["node"])
    sets = rows.written(sets.select("node", F.size("set").alias("size"), "set", "bag"))
    first = rows.written(_similar(close, sets, similar))
    members = rows.written(members.join(components(first), "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root")))
    few = members.where(f"n <= {CROWD}").select("key", F.col("node").alias("u"), F.col("root").alias("ru"))
    few = few.join(few.select("key", F.col("u").alias("v"), F.col("ru").alias("rv")), "key").where("u < v and ru <> rv").select("u", "v")
    crowds = members.where(f"n > {CROWD}").select("key", "node", "root")
    least = crowds.groupBy("key").agg(F.min(F.struct("node", "root")).alias("m"))
    stars = crowds.join(least, "key").where("root <> m.root").select(F.col("m.node").alias("u"), F.col("node").alias("v"))
    edges = rows.written(_similar(few.unionByName(stars), sets, similar).unionByName(first))
    parts = crowds.select("key", "node").join(components(edges), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = parts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    nodes = rows.written(parts.join(mixed, "key").select("node", "root").distinct())
    rows.dropped(met, close, needed, first, members)
    out = rows.written(edges.unionByName(_similar(_prefix_pairs(nodes, sets, similar), sets, similar)))
    rows.dropped(sets, edges, nodes)
    return out


def near_copies(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id that chains of texts of at least ``similar`` reach, the
    document itself included. Texts without words are copies of each other; very long texts are one
    set, held in one task. Rows with a null id keep their component's id, which is null only if no
    row of it has one. Repeated rows come back as often as they are there; an empty table gives an
    empty result; other columns are not read.
    """
    rows.bounded_batches(docs.sparkSession)
    signed = rows.written(docs.select("doc_id", "text").mapInArrow(_signed(words), "doc_id long, node long, fp long, keys array<long>"))
    each = rows.written(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    found = links(docs, each.where("size(keys) > 0").select("node", "fp", "keys"), words, similar)
    roots = components(found)
    rows.dropped(found)
    linked = each.select("node", "first").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = linked.join(least, "root").select("node", "component_id")
    alone = each.where("n > 1").join(groups.select("node"), "node", "left_anti").select("node", F.col("first").alias("component_id"))
    groups = rows.counted(groups.unionByName(alone))
    rows.dropped(each)
    out = signed.select("doc_id", "node").join(rows.small(groups), "node", "left")
    return out.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
