import datetime
import json
import os
import time
import uuid

import pytest

from rinkspark.operators import merge
from rinkspark.sources import rest
from rinkspark.streaming import fetch

DAY = datetime.datetime(2024, 1, 1)


def _site(folder, name, answer):
    """A source whose requests leave a file with their time in ``folder``."""

    def get(url):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([time.time(), url]))
        return answer(url)

    return type("Site", (rest.RestSource,), {"get": staticmethod(get), "name": classmethod(lambda cls: name)})


def _asked(folder):
    return sorted(tuple(json.loads(open(f"{folder}/{f}").read())) for f in os.listdir(folder))


def test_ledger_keeps_what_is_left_of_the_burst():
    now = [0.0]
    ledger = rest.Ledger(10, 2.0, lambda: now[0])
    assert [ledger.reserve(4), ledger.reserve(20)] == [10, 6]
    now[0] = 3.0
    assert ledger.reserve(1) == -8
    now[0] = 1000.0
    assert ledger.reserve(1) == 10


def test_more_task_slots_than_lanes_make_no_more_requests(spark, tmp_path):
    site = _site(str(tmp_path), "paced", lambda url: url)
    rate, burst, n = 20.0, 4.0, 24
    for part in range(2):  # the second read finds no burst left
        urls = [f"http://paced{tmp_path}/{part}/{i}" for i in range(n)]
        rows = rest.fetched(spark, urls, site, 2, rate=rate, burst=burst).collect()
        assert sorted((r.place, r.body) for r in rows) == list(enumerate(urls))
    times = [t for t, _ in _asked(tmp_path)]
    assert len(times) == 2 * n
    most = max(sum(a <= t < a + 1 for t in times) for a in times)
    assert most <= burst + rate + 1
    assert times[-1] - times[0] >= (2 * n - burst) / rate - 0.2


def test_runs_go_on_where_the_store_is(spark, tmp_path):
    """A request that fails ends the run; started again from its checkpoint it loses and repeats no row."""
    os.makedirs(tmp_path / "asked")
    broken = tmp_path / "broken"
    broken.touch()

    def answer(url):
        n = int(url.rsplit("/", 1)[1])
        if n == 17 and os.path.exists(broken):
            raise ValueError("no answer")
        return json.dumps([{"pid": n, "task_date": (DAY + datetime.timedelta(days=d)).isoformat(), "total_tpe": 10 * n + d} for d in range(n % 4)])

    def decode(raw):
        return rest.decoded(raw, "pid:bigint,task_date:timestamp,total_tpe:int").selectExpr("pid AS player_id", "task_date", "total_tpe", "total_tpe AS ordinal")

    site = _site(str(tmp_path / "asked"), "restarted", answer)
    store = merge.Store(spark, str(tmp_path / "store"))
    run = fetch.FetchMerge(store, "tpe", "first", decode, "player_id", "task_date", "ordinal", site, 2, flush_rows=12, rate=10_000.0, burst=1000.0)
    urls = [f"http://h{tmp_path}/{n}" for n in range(30)]
    with pytest.raises(Exception, match="no answer"):
        run.run(spark, urls, str(tmp_path / "cp"), admitted=5)
    assert run.progress(store.change()) == 15 and store.read("tpe").count() < 30
    before = len(_asked(tmp_path / "asked"))
    broken.unlink()
    assert run.run(spark, ["http://h/another"], str(tmp_path / "cp"), admitted=5) == 30  # the list that it began with
    want = {(n, DAY + datetime.timedelta(days=d)): 10 * n + d for n in range(30) for d in range(n % 4)}
    assert {(r.player_id, r.task_date): r.total_tpe for r in store.read("tpe").collect()} == want
    assert store.read("tpe").count() == len(want) and store.read("tpe_waiting").count() == 0
    again = [u for _, u in _asked(tmp_path / "asked")[before:]]
    assert sorted(again) == sorted(urls[15:])  # nothing that was published is asked for again
    versions = len(store.versions())
    run.batch(spark.createDataFrame([(29, urls[29])], "n long, url string"), 30)  # a batch that was published, run again
    assert len(store.versions()) == versions
    second = fetch.FetchMerge(store, "tpe", "second", decode, "player_id", "task_date", "ordinal", site, 2, rate=10_000.0, burst=1000.0)
    assert second.run(spark, urls[5:7], str(tmp_path / "cp2")) == 2 and store.read("tpe").count() == len(want)


def test_a_failing_source_holds_back_no_other(spark, tmp_path):
    for name in ("a", "b"):
        os.makedirs(tmp_path / name)
    broken = tmp_path / "broken"
    broken.touch()

    def answer(url):
        n = int(url.rsplit("/", 1)[1])
        if "bad" in url and n == 4 and os.path.exists(broken):
            raise ValueError("out of order")
        return json.dumps([{"pid": n, "task_date": (DAY + datetime.timedelta(days=n)).isoformat(), "total_tpe": n}])

    def decode(raw):
        return rest.decoded(raw, "pid:bigint,task_date:timestamp,total_tpe:int").selectExpr("pid AS player_id", "task_date", "total_tpe", "total_tpe AS ordinal")

    store, sources = merge.Store(spark, str(tmp_path / "store")), {}
    for name, kind in (("a", "bad"), ("b", "good")):
        site = _site(str(tmp_path / name), f"crawled_{kind}", answer)
        run = fetch.FetchMerge(store, f"tpe_{kind}", "first", decode, "player_id", "task_date", "ordinal", site, 2, flush_rows=2, rate=10_000.0, burst=1000.0)
        sources[kind] = run, [f"http://{kind}{tmp_path}/{n}" for n in range(6)]
    first = {r.source: r for r in fetch.crawl(spark, store, sources, str(tmp_path / "cp"), admitted=2).collect()}
    assert (first["bad"].worked_off, first["bad"].watermark) == (4, DAY + datetime.timedelta(days=3)) and "order" in first["bad"].error or first["bad"].error
    assert (first["good"].requests, first["good"].worked_off, first["good"].error) == (6, 6, None)
    broken.unlink()
    asked = len(_asked(tmp_path / "b"))
    second = {r.source: (r.worked_off, r.watermark, r.error) for r in fetch.crawl(spark, store, sources, str(tmp_path / "cp"), admitted=2).collect()}
    assert second == {k: (6, DAY + datetime.timedelta(days=5), None) for k in ("bad", "good")}
    assert store.read("tpe_bad").count() == 6 and len(_asked(tmp_path / "b")) == asked
