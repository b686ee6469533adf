"""Near-duplicates by 64-bit SimHash, found with deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. Fingerprints that differ in at most two bits
differ in at most one bit on one of the segments, so they agree on one of that segment's
one-wildcard variants. The 64 variants of each distinct fingerprint are equality-joined; what
meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows
from rinkspark.llm.components import components

SEED = 42
WORDS = 3
RADIUS = 2
#: Members of a variant up to which all its pairs are verified; beyond it the key is refined.
CROWD = 24


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of whole ``text``: a bit is 1 if set in over half of the shingles' XXH64 values."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), 0
    for lo in range(0, n, 1 << 16):
        h = np.array([digest(join(parts[i : i + words]), SEED) for i in range(lo, min(n, lo + (1 << 16)))], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return find


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row."""
    rows.bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp): 64 one-wildcard variants of the segments; a key holds segment, wildcard and the rest."""
    out = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    half = "(case when k < 32 then fp & 4294967295L else shiftrightunsigned(fp, 32) end)"
    return out.select(F.expr(f"shiftleft(cast(k as bigint), 32) | ({half} & ~shiftleft(1L, k % 32))").alias("key"), "fp")


def links(prints: DataFrame, whole: bool = True) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct ``fp`` values within two bits of each other.

    Pairs that meet in a variant of few members are verified one by one. The members of a crowded
    variant meet again on variants of the whole fingerprint with two wildcards: at most four values
    share one, all of them within two bits, and a star over those four keeps what is connected. The
    rows grow with the members, never with their square, and no link between components is lost.
    Unless ``whole``, for a caller with another way to the rest, members of a crowded variant only
    meet the least of them.
    """
    # few files may hold many fingerprints: they are spread before each becomes 64 rows
    keyed = _variants(prints.repartition("fp"))
    met = rows.counted(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), more=F.count_if(F.col("n") > 2))
    close = f"bit_count(u ^ v) <= {RADIUS}"
    two = met.where("n = 2").where(close).select("u", "v")
    more = met.where("n > 2").select("key", "n")
    members = rows.written(keyed.join(rows.small(more, met._counted["more"]), "key"))
    few = members.where(f"n <= {CROWD}").select("key", F.col("fp").alias("u"))
    few = few.join(few.select("key", F.col("u").alias("v")), "key").where("u < v").where(close).select("u", "v")
    if not whole:
        crowd = members.where(f"n > {CROWD}").join(met.select("key", "u"), "key").where("fp <> u").select("u", F.col("fp").alias("v")).where(close)
        return two.unionByName(few).unionByName(crowd).distinct()
    crowd = members.where(f"n > {CROWD}").select("fp").distinct()
    crowd = crowd.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
    crowd = crowd.select("fp", "i", F.explode(F.expr("sequence(i + 1, 63)")).alias("j"))
    crowd = crowd.select("fp", "i", "j", F.expr("fp & ~(shiftleft(1L, i) | shiftleft(1L, j))").alias("rest"))
    crowd = crowd.groupBy("i", "j", "rest").agg(F.sort_array(F.collect_set("fp")).alias("all")).where("size(all) > 1")
    crowd = crowd.select(F.col("all")[0].alias("u"), F.explode(F.expr("slice(all, 2, 3)")).alias("v"))
    return two.unionByName(few).unionByName(crowd).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id that can be reached over links, the document itself
    included. A null or empty text has fingerprint zero, which links like any other. Rows with a
    null id keep their component's id, which is null only if no row of it has one. Repeated rows
    come back as often as they are there; an empty table gives an empty result.
    """
    prints = rows.written(fingerprints(docs, words))
    each = rows.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(each.select("fp")))
    linked = each.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = linked.join(least, "root").select("fp", "component_id")
    alone = each.where("n > 1").join(groups.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    groups = rows.counted(groups.unionByName(alone))
    out = prints.join(rows.small(groups), "fp", "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
