"""Fetch and merge as a stream: requests are admitted a few at a time, fetched in lanes, and merged in batches of rows.

The stream's source holds nothing but the list of requests, and its offset is a place in the list: a
micro-batch admits the next few. They are fetched by tasks under the sites' rate, and what comes back
waits in the store until there is enough for one merge, or the list has ended. The rows that wait, the
table, and how far the list has been worked off are published together, as one version of the store,
so a run that is started again from its checkpoint goes on where the store is: nothing is merged
twice, and what was fetched but not published is fetched again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from rinkspark.operators import merge
from rinkspark.sources import rest
from rinkspark.streaming import increments

#: Requests that one micro-batch admits, and rows from which a merge is worth it.
ADMITTED = 64
FLUSH_ROWS = 2_000


class _Requests(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.urls, self.admitted = json.loads(options["urls"]), int(options["admitted"])

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"next": min(len(self.urls), start["next"] + self.admitted)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(i, self.urls[i]) for i in range(start["next"], end["next"])])


class RequestSource(DataSource):
    """(n, url): a list of requests as a stream, so many a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "requests"

    def schema(self) -> str:
        return "n long, url string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Requests(dict(self.options))


class FetchMerge:
    """One run over a list of requests, into a store table kept under each key's overlap.

    ``decode`` makes rows of the table's columns and ``ordinal`` from (url, body, place); of rows for one
    key and moment the one with the greatest ordinal wins. ``run`` names the list: the store keeps its
    requests and its progress under this name, and a run that is started again takes up both.
    """

    def __init__(self, store: merge.Store, table: str, run: str, decode: Callable[[DataFrame], DataFrame], key: str, at: str, ordinal: str, source: type[rest.RestSource] = rest.RestSource, parallel: int = 8, days: int = increments.OVERLAP_DAYS, flush_rows: int = FLUSH_ROWS, **limits: float):
        self.store, self.table, self.run_name, self.decode = store, table, run, decode
        self.key, self.at, self.ordinal, self.days = key, at, ordinal, days
        self.source, self.parallel, self.flush_rows, self.limits = source, parallel, flush_rows, limits

    def requests(self, spark: SparkSession, urls: list[str]) -> list[str]:
        """The run's requests: those that it began with, or these."""
        name = f"{self.table}_requests"
        known = self.store.read(name)
        mine = known.where(F.col("run") == self.run_name) if known is not None else None
        if mine is None or mine.isEmpty():
            fresh = spark.createDataFrame([(self.run_name, i, u) for i, u in enumerate(urls)], "run string, n long, url string")
            self.store.merge(name, fresh, ["run", "n"])
            return urls
        return [r.url for r in mine.orderBy("n").collect()]

    def progress(self, change: merge.Change) -> int:
        """How many requests of the run have been worked off."""
        known = change.read(f"{self.table}_progress")
        row = known.where(F.col("run") == self.run_name).first() if known is not None else None
        return row.done if row else 0

    def batch(self, admitted: DataFrame, total: int) -> None:
        """Fetches the admitted requests that aren't worked off yet and publishes one version."""
        spark, change = admitted.sparkSession, self.store.change()
        done = self.progress(change)
        asked = sorted((r.n, r.url) for r in admitted.where(F.col("n") >= done).collect())
        if not asked:
            return
        raw = rest.fetched(spark, [u for _, u in asked], self.source, self.parallel, **self.limits)
        rows = self.decode(raw).withColumn("_batch", F.lit(asked[0][0]).cast("long"))
        waiting, ended = change.read(f"{self.table}_waiting"), asked[-1][0] + 1 == total
        every = (rows if waiting is None else waiting.unionByName(rows)).persist()
        try:
            if every.count() >= self.flush_rows or ended:
                # of rows that were fetched one after another the later wins, and within a fetch the greater ordinal
                order = F.struct("_batch", self.ordinal)
                increments.staged_overlap(change, self.table, every.withColumn(self.ordinal, order).drop("_batch"), self.key, self.at, self.ordinal, self.days)
                change.put(f"{self.table}_waiting", every.limit(0))
            else:
                change.put(f"{self.table}_waiting", every)
            mark = spark.createDataFrame([(self.run_name, asked[-1][0] + 1)], "run string, done long")
            change.merge(f"{self.table}_progress", mark, ["run"])
            change.publish()
        finally:
            every.unpersist()

    def run(self, spark: SparkSession, urls: list[str], checkpoint: str, admitted: int = ADMITTED) -> int:
        """Works the list off, from where an earlier start of this run stopped; returns the number of requests."""
        if not urls:
            return 0
        urls = self.requests(spark, urls)
        spark.dataSource.register(RequestSource)
        stream = spark.readStream.format(RequestSource.name()).options(urls=json.dumps(urls), admitted=str(admitted)).load()
        query = stream.writeStream.foreachBatch(lambda df, _: self.batch(df, len(urls))).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return len(urls)


CRAWLED = "source string, requests long, worked_off long, watermark timestamp, error string"


def crawl(spark: SparkSession, store: merge.Store, sources: dict[str, tuple[FetchMerge, list[str]]], checkpoints: str, admitted: int = ADMITTED) -> DataFrame:
    """Works off several sources' lists, one after another; returns the store's table of how far each is.

    The table ``crawl(source, requests, worked_off, watermark, error)`` has a row a source: the watermark
    is the last moment that its table holds. A source that fails leaves its error there and what it has
    published before, and holds back no other; called again, it goes on where it stopped, and sources
    that are done ask for nothing.
    """
    for name, (run, urls) in sources.items():
        error = None
        try:
            run.run(spark, urls, f"{checkpoints}/{name}", admitted)
        except Exception as e:  # whatever a source raises is its own: it is recorded, and the next one runs
            error = str(e).strip().splitlines()[0][:500] if str(e).strip() else type(e).__name__
        change = store.change()
        last = change.read(f"{run.table}_last")
        watermark = last.agg(F.max("last").cast("timestamp").alias("m")).first().m if last is not None else None
        total = change.read(f"{run.table}_requests")
        asked = total.where(F.col("run") == run.run_name).count() if total is not None else len(urls)
        change.merge("crawl", spark.createDataFrame([(name, asked, run.progress(change), watermark, error)], CRAWLED), ["source"])
        change.publish()
    return store.read("crawl")
