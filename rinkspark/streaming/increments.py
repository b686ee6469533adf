"""Incremental ingest: overlap windows by key, bounded backfill, choice of increments."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.operators import latest, merge

OVERLAP_DAYS = 30
GRACE_DAYS = 90
REFRESHED_SEASONS = 2
BACKFILL_BATCH = 200


def eligible(status: Column, retired_at: Column, now: Column) -> Column:
    """Active players, and those retired within the grace period; pending and denied ones never."""
    return (status == 2) | ((status == 3) & (retired_at >= now - F.expr(f"interval {GRACE_DAYS} days")))


def cutoffs(stored: DataFrame, key: str, at: str, days: int = OVERLAP_DAYS) -> DataFrame:
    """(key, cutoff): each key's last stored moment less the overlap."""
    return stored.groupBy(key).agg((F.max(at) - F.expr(f"interval {days} days")).alias("cutoff"))


def overlapping(incoming: DataFrame, stored: DataFrame, key: str, at: str, days: int = OVERLAP_DAYS) -> DataFrame:
    """Incoming rows from the key's cutoff on, the cutoff included; all rows of keys not stored yet."""
    out = incoming.join(cutoffs(stored, key, at, days), key, "left")
    return out.where(F.col("cutoff").isNull() | (F.col(at) >= F.col("cutoff"))).drop("cutoff")


def overlap_merged(stored: DataFrame, incoming: DataFrame, key: str, at: str, ordinal: str, days: int = OVERLAP_DAYS) -> DataFrame:
    """``stored`` after a merge of what overlaps; of rows for the same moment the last one wins.

    Values may fall inside the window. Adds ``change`` as ``merge.merged`` does.
    """
    recent = latest.last_wins(overlapping(incoming, stored, key, at, days), [key, at], ordinal)
    return merge.merged(stored, recent.select(*stored.columns), [key, at])


def backfill_batch(candidates: DataFrame, done: DataFrame, key: str, size: int = BACKFILL_BATCH) -> DataFrame:
    """The next keys to fetch in full: not marked yet, by key."""
    return candidates.select(key).join(done.select(key), key, "left_anti").orderBy(key).limit(size)


def backfill(stored: DataFrame, done: DataFrame, batch: DataFrame, fetched: DataFrame, keys: list[str], ordinal: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(stored, done) after fetching a batch; keys without any rows are marked too."""
    rows = latest.last_wins(fetched, keys, ordinal).select(*stored.columns)
    marks = batch.select(keys[0]).withColumn(done.columns[1], now)
    return merge.merged(stored, rows, keys).drop("change"), done.unionByName(marks.join(done.select(keys[0]), keys[0], "left_anti"))


#: Seasons up to this one have no index data.
SEASON_FLOOR = 65


def above_floor(df: DataFrame, season: str = "season", floor: int = SEASON_FLOOR) -> DataFrame:
    """Rows of seasons after the floor."""
    return df.where(F.col(season) > floor)


def recent_seasons(last: int, n: int = REFRESHED_SEASONS) -> list[int]:
    return [s for s in range(last, last - n, -1) if s >= 1]


def probe_season(last: int, n: int = REFRESHED_SEASONS) -> int | None:
    """The season just before the refreshed ones: if it is stored, so is all history."""
    return last - n if last - n >= 1 else None


def seasons_to_fetch(stored: DataFrame, last: int, season: str = "season") -> list[int] | None:
    """Recent seasons if the probe is stored, or there is nothing before them; else none: all history."""
    probe = probe_season(last)
    known = probe is None or not stored.where(F.col(season) == probe).isEmpty()
    return recent_seasons(last) if known else None


def staged_overlap(change: merge.Change, table: str, incoming: DataFrame, key: str, at: str, ordinal: str, days: int = OVERLAP_DAYS, rows: int = merge.FILE_ROWS) -> DataFrame:
    """Stages a batch under each key's overlap; returns counts by change.

    The table is kept in files by time and key, so a batch of recent rows rewrites the last ones. Each
    key's last moment is a table of its own beside it, ``<table>_last``: a cutoff needs no look at the rest.
    """
    last = change.read(f"{table}_last")
    kept = incoming
    if last is not None:
        cutoff = last.select(key, (F.col("last") - F.expr(f"interval {days} days")).alias("cutoff"))
        kept = incoming.join(cutoff, key, "left").where(F.col("cutoff").isNull() | (F.col(at) >= F.col("cutoff"))).drop("cutoff")
    new = latest.last_wins(kept, [key, at], ordinal).drop(ordinal).persist()
    try:
        counts = change.merge_ordered(table, new, [key, at], [at, key], rows=rows)
        moments = new.groupBy(key).agg(F.max(at).alias("last"))
        if last is not None:
            moments = moments.join(last.withColumnRenamed("last", "_last"), key, "left").select(key, F.greatest("last", "_last").alias("last"))
        change.merge(f"{table}_last", moments, [key])
    finally:
        new.unpersist()
    return counts


def overlap_change(store: merge.Store, table: str, incoming: DataFrame, key: str, at: str, ordinal: str, days: int = OVERLAP_DAYS, rows: int = merge.FILE_ROWS) -> None:
    """Merges a batch into a store table under each key's overlap and publishes one version."""
    change = store.change()
    staged_overlap(change, table, incoming, key, at, ordinal, days, rows)
    change.publish()


def overlap_stream(source: DataFrame, store: merge.Store, table: str, key: str, at: str, ordinal: str, checkpoint: str, days: int = OVERLAP_DAYS, rows: int = merge.FILE_ROWS):
    """Merges a stream's batches into a store table under its overlap; runs what is there and stops.

    The overlap is a key's own, not a watermark of the whole stream, so no key loses rows because
    another is ahead. Each batch publishes one version; one that is run again changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            overlap_change(store, table, df, key, at, ordinal, days, rows)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# How long results of a known and of an unknown data version are kept, and a directory.
KNOWN_SECONDS = 12 * 3600
UNKNOWN_SECONDS = 60
DIRECTORY_SECONDS = 6 * 3600


class VersionCache:
    """Frames by data version: a new version drops what the old one held, as does age.

    A version of None is not known, and what is held under it is soon too old. One thread at a time
    makes a frame, and others wait for it.
    """

    def __init__(self, version: Callable[[], str | None], known: float = KNOWN_SECONDS, unknown: float = UNKNOWN_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.version, self.known, self.unknown, self.clock = version, known, unknown, clock
        self.held: dict[str, tuple[float, DataFrame]] = {}
        self.at: str | None = None
        self.lock = threading.Lock()

    def _fresh(self, name: str) -> DataFrame | None:
        made, df = self.held.get(name, (None, None))
        return df if made is not None and self.clock() - made < (self.unknown if self.at is None else self.known) else None

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.version()
        if now == self.at and (df := self._fresh(name)) is not None:
            return df
        with self.lock:
            if now != self.at:
                for _, df in self.held.values():
                    df.unpersist()
                self.held, self.at = {}, now
            if (df := self._fresh(name)) is None:
                if name in self.held:
                    self.held[name][1].unpersist()
                df = make().persist()
                self.held[name] = self.clock(), df
            return df


def directory_cache(clock: Callable[[], float] = time.monotonic) -> VersionCache:
    """A cache for lists of names that are asked for often and change seldom."""
    return VersionCache(lambda: "", DIRECTORY_SECONDS, DIRECTORY_SECONDS, clock)


class Once:
    """Runs an action at most once, whichever thread asks first; a failed run may be tried again."""

    def __init__(self):
        self.done, self.lock = False, threading.Lock()

    def run(self, action: Callable[[], None]) -> bool:
        """Whether this call ran it."""
        if self.done:
            return False
        with self.lock:
            if self.done:
                return False
            action()
            self.done = True
            return True


def every(seconds: float, action: Callable[[], None], rounds: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs ``action`` each ``seconds``, one run after the other; starts that a long run misses are left out."""
    start, n = clock(), 0
    while rounds is None or n < rounds:
        action()
        n += 1
        late = clock() - start
        start += seconds * max(1, math.ceil(late / seconds))
        if rounds is None or n < rounds:
            sleep(max(0.0, start - clock()))
    return n
