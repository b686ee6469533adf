"""REST endpoints as a data source: a few lanes of requests, throttled and retried in the reader.

The sites ask for one rate and burst for all that comes from here, however many executors there are.
So requests are dealt to ``parallel`` lanes, a partition each, and a lane has its part of the rate: no
number of task slots makes more. What is left of the burst is kept by the driver, from one read to the
next: a read takes what is there, and a long one leaves a debt that the next waits for. A task that is
run again, as after a lost executor, begins without a burst. Speculative execution would ask twice at a
time and has to be off.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The limits that the upstream sites ask for.
BUCKET = 100
PER_SECOND = 30.0
FIRST_DELAY = 1.0
ATTEMPTS = 5

#: The endpoints by name: path, and the parameters that the server filters by.
ENDPOINTS = {
    "leagues": ("leagues", ()),
    "seasons": ("leagues/seasons", ("league",)),
    "conferences": ("conferences", ("league", "season")),
    "conference": ("conferences/{id}", ("id", "league", "season")),
    "divisions": ("divisions", ("league", "season", "conference")),
    "teams": ("teams", ("league", "conference", "division", "season")),
    "team": ("teams/{id}", ("id", "league", "season")),
    "roster": ("teams/{id}/roster", ("id", "league", "season")),
    "schedule": ("schedule", ("league", "season")),
    "players": ("players", ()),
    "player": ("players/{id}", ("id", "league", "season")),
    "player_stats": ("players/stats", ("league", "season", "type")),
    "timeline": ("tpetimeline", ("pid",)),
    "earned": ("tpeevents/season", ("pid", "season", "league", "team", "draft", "user")),
}


class Bucket:
    """A token bucket: a burst, then so many a second."""

    def __init__(self, size: float = BUCKET, rate: float = PER_SECOND, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.size, self.rate, self.clock, self.sleep = size, rate, clock, sleep
        self.tokens, self.at = size, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.size, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1, self.clock()
        self.tokens -= 1


def retried(call: Callable[[], str], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again after 1, 2, 4 ... seconds; the last error is raised, and at once what asking again can't mend."""
    for n in range(attempts):
        try:
            return call()
        except OSError as e:
            refused = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code not in (408, 429)
            if refused or n == attempts - 1:
                raise
            sleep(FIRST_DELAY * 2**n)
    raise AssertionError


def fetch(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as answer:
        return answer.read().decode()


class Ledger:
    """What is left of the burst that a site allows, as the driver has given it out; below zero, requests still to come."""

    def __init__(self, size: float, rate: float, clock: Callable[[], float] = time.monotonic):
        self.size, self.rate, self.clock, self.lock = size, rate, clock, threading.Lock()
        self.tokens, self.at = size, clock()

    def reserve(self, n: int) -> float:
        """Books ``n`` requests; returns the tokens that there were before."""
        with self.lock:
            now = self.clock()
            self.tokens = min(self.size, self.tokens + (now - self.at) * self.rate)
            self.at = now
            before = self.tokens
            self.tokens -= n
            return before


#: A ledger a site, rate and burst.
_ledgers: dict[tuple[str, float, float], Ledger] = {}


class _Lane(InputPartition):
    """Requests that follow one another: (url, place) of each, the rate, and the tokens to begin with."""

    def __init__(self, urls: list[tuple[str, int]], rate: float, tokens: float):
        super().__init__(urls)
        self.rate, self.tokens = rate, tokens


class _Reader(DataSourceReader):
    def __init__(self, options: dict, get: Callable[[str], str]):
        self.urls, self.get = json.loads(options["urls"]), get
        self.parallel = max(1, int(options.get("parallel", 1)))
        self.rate, self.tokens = float(options.get("rate", PER_SECOND)), float(options.get("tokens", 0))

    def partitions(self) -> list[InputPartition]:
        lanes = min(self.parallel, max(1, len(self.urls)))
        return [_Lane([(u, i) for i, u in enumerate(self.urls)][k::lanes], self.rate / lanes, self.tokens / lanes) for k in range(lanes)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        context = TaskContext.get()
        again = context is not None and context.attemptNumber() > 0
        bucket = Bucket(max(1.0, partition.tokens), partition.rate)
        bucket.tokens = min(0.0, partition.tokens) if again else partition.tokens

        for url, place in partition.value:

            def ask(url: str = url) -> str:
                bucket.take()
                return self.get(url)

            yield url, retried(ask), place


class RestSource(DataSource):
    """(url, body, place) of the listed requests, ``place`` from zero on in the order of the list."""

    get: Callable[[str], str] = staticmethod(fetch)

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "url string, body string, place int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), type(self).get)


def request_urls(base: str, endpoint: str, parameters: list[dict]) -> list[str]:
    """One URL for each set of parameters; only those that the endpoint filters by, nulls left out."""
    path, known = ENDPOINTS[endpoint]
    out = []
    for p in parameters or [{}]:
        if wrong := set(p) - set(known):
            raise ValueError(f"{endpoint} has no {', '.join(sorted(wrong))}")
        query = urllib.parse.urlencode([(k, p[k]) for k in known if p.get(k) is not None and f"{{{k}}}" not in path])
        place = path.format(**{k: urllib.parse.quote(str(v), safe="") for k, v in p.items()})
        out.append(f"{base.rstrip('/')}/{place}" + (f"?{query}" if query else ""))
    return out


def fetched(spark: SparkSession, urls: list[str], source: type[RestSource] = RestSource, parallel: int = 8, rate: float = PER_SECOND, burst: float = BUCKET) -> DataFrame:
    """(url, body, place) of requests, ``parallel`` at a time sharing the rate.

    The requests are booked here, once, so the frame is to be read once: write it before using it twice.
    """
    spark.dataSource.register(source)
    site = urllib.parse.urlsplit(urls[0]).netloc if urls else ""
    tokens = _ledgers.setdefault((site, burst, rate), Ledger(burst, rate)).reserve(len(urls))
    return spark.read.format(source.name()).options(urls=json.dumps(urls), parallel=str(parallel), rate=str(rate), tokens=str(tokens)).load()


def load(spark: SparkSession, base: str, endpoint: str, parameters: list[dict], source: type[RestSource] = RestSource, parallel: int = 8) -> DataFrame:
    """(url, body, place) of an endpoint."""
    return fetched(spark, request_urls(base, endpoint, parameters), source, parallel)


def decoded(raw: DataFrame, schema: str) -> DataFrame:
    """The objects of JSON bodies that are lists, as typed rows."""
    return raw.select(F.explode(F.from_json("body", f"array<struct<{schema}>>")).alias("o")).select("o.*")
