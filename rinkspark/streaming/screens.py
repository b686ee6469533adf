"""Settled screens of a frame stream, and captures stored once by content hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rinkspark.session import checkpoints

#: Frames are the same screen from this share of equal hash bits on.
SIMILARITY = 98.0
BITS = 64


def similar(a: int, b: int, least: float = SIMILARITY) -> bool:
    return (BITS - ((a ^ b) & (2**BITS - 1)).bit_count()) * 100 / BITS >= least


def settle(frames: Iterator[tuple[int, int]], last: int | None = None, candidate: int | None = None):
    """(emitted ordinals, last, candidate): a screen counts at its second like frame in a row.

    A frame like the last emitted screen changes nothing, not even the candidate.
    """
    out = []
    for ordinal, value in frames:
        if last is not None and similar(value, last):
            continue
        if candidate is not None and similar(value, candidate):
            out.append(ordinal)
            last, candidate = value, None
        else:
            candidate = value
    return out, last, candidate


#: Frames of one source that a task folds together.
SEGMENT = 50_000


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, last, candidate, ordinals) of segments, each from the state before it."""
    for batch in batches:
        found = []
        for seg, frames, last, candidate in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            out, last, candidate = settle(((f["ordinal"], f["hash"]) for f in frames), last, candidate)
            found.append((seg, last, candidate, out))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = zip(*found, strict=True) if found else ([],) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seg", "last", "candidate", "out"])


def settled(frames: DataFrame, source: str = "source", ordinal: str = "ordinal", value: str = "hash", segment: int = SEGMENT) -> DataFrame:
    """(source, ordinal): settled frames of a finished table, however many one source has.

    Frames are ordered by ranges and cut into segments. All segments are folded at once, each as if
    nothing came before it, and then again those whose predecessor ended in another state than assumed,
    until none did. What a segment emits last settles its end, whatever was before, so a changed start
    seldom reaches its successor. Sources and ordinals are not null, ordinals of a source not repeated.
    """
    checkpoints(frames.sparkSession)
    order = [source, ordinal]
    ordered = frames.select(source, F.col(ordinal).cast("long").alias(ordinal), value).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ordered.withColumn("_n", F.monotonically_increasing_id())
    cut = placed.groupBy(source, F.expr(f"_n div {segment}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("ordinal"), F.col(value).alias("hash")))).alias("frames"))
    by = Window.partitionBy(source).orderBy("_block")  # a row a segment
    cut = cut.withColumn("seg", F.monotonically_increasing_id()).checkpoint()
    cut = cut.withColumn("before", F.lag("seg").over(by)).checkpoint()
    none = F.lit(None).cast("long")
    now = cut.select("seg", "before", "frames", none.alias("last"), none.alias("candidate"))
    states = now.select("seg", "frames", "last", "candidate").mapInArrow(_folded, "seg long, last long, candidate long, out array<long>").checkpoint()
    begun = now.select("seg", "before", "last", "candidate").checkpoint()
    while True:
        ends = states.select(F.col("seg").alias("before"), F.col("last").alias("_last"), F.col("candidate").alias("_candidate"))
        told = begun.join(ends, "before", "left")
        other = ~(F.col("last").eqNullSafe(F.col("_last")) & F.col("candidate").eqNullSafe(F.col("_candidate")))
        wrong = told.where(F.col("before").isNotNull() & other).select("seg", F.col("_last").alias("last"), F.col("_candidate").alias("candidate")).checkpoint()
        if wrong.isEmpty():
            break
        again = cut.select("seg", "frames").join(wrong, "seg").select("seg", "frames", "last", "candidate")
        again = again.mapInArrow(_folded, "seg long, last long, candidate long, out array<long>")
        states = states.join(wrong, "seg", "left_anti").unionByName(again).checkpoint()
        begun = begun.join(wrong.select("seg"), "seg", "left_anti").unionByName(cut.select("seg", "before").join(wrong, "seg")).checkpoint()
    kind = frames.schema[ordinal].dataType
    return cut.select(source, "seg").join(states, "seg").select(source, F.explode("out").alias(ordinal)).withColumn(ordinal, F.col(ordinal).cast(kind))


class Settle(StatefulProcessor):
    """Keeps the last emitted screen and the candidate of every source."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("screens", "last long, candidate long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, None)
        frames = pd.concat(list(rows)).sort_values("ordinal")
        out, last, candidate = settle(zip(frames["ordinal"].tolist(), frames["hash"].tolist()), *held)
        self.state.update((last, candidate))
        yield pd.DataFrame({"source": pd.Series([key[0]] * len(out), dtype=object), "ordinal": pd.Series(out, dtype="int64")})

    def close(self) -> None:
        pass


def settled_stream(frames: DataFrame) -> DataFrame:
    """(source, ordinal) of the stream ``frames(source, ordinal, hash)``, state by source."""
    return frames.groupBy("source").transformWithStateInPandas(Settle(), "source string, ordinal long", "Append", "None")


def once(captures: DataFrame, key: str = "content_hash") -> DataFrame:
    """Each content hash once, over the whole stream."""
    return captures.dropDuplicates([key])
