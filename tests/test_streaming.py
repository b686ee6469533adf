import datetime

from pyspark.sql import functions as F

from rinkspark.operators import merge
from rinkspark.streaming import increments, screens

DAY = datetime.datetime(2024, 1, 1)
day = lambda n: DAY + datetime.timedelta(days=n)
TPE = "player_id int, task_date timestamp, total_tpe int"


def test_overlap(spark):
    stored = spark.createDataFrame([(1, day(0), 5), (1, day(40), 9)], TPE)
    new = spark.createDataFrame([(1, day(5), 1, 0), (1, day(10), 2, 1), (1, day(40), 10, 2), (1, day(40), 7, 3), (2, day(0), 4, 4)], TPE + ", ordinal int")
    out = {(r.player_id, r.task_date): r.total_tpe for r in increments.overlap_merged(stored, new, "player_id", "task_date", "ordinal").collect()}
    assert out == {(1, day(0)): 5, (1, day(10)): 2, (1, day(40)): 7, (2, day(0)): 4}


def test_seasons():
    assert [increments.recent_seasons(n) for n in (67, 1, 2)] == [[67, 66], [1], [2, 1]]
    assert [increments.probe_season(n) for n in (67, 1, 2, 3)] == [65, None, None, 1]


def test_season_choice(spark):
    stored = spark.createDataFrame([(65,)], "season int")
    assert increments.seasons_to_fetch(stored, 67) == [67, 66]
    assert increments.seasons_to_fetch(stored, 68) is None


def test_backfill(spark):
    players = spark.createDataFrame([(i,) for i in range(1, 7)], "player_id int")
    done = spark.createDataFrame([(5, DAY)], "player_id int, backfilled_at timestamp")
    batch = increments.backfill_batch(players.where("player_id >= 5"), done, "player_id")
    assert [r.player_id for r in batch.collect()] == [6]
    fetched = spark.createDataFrame([], TPE + ", ordinal int")
    _, after = increments.backfill(spark.createDataFrame([], TPE), done, batch, fetched, ["player_id", "task_date"], "ordinal", F.lit(DAY))
    assert {r.player_id for r in after.collect()} == {5, 6}


def test_overlap_stream(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "store"))
    schema = TPE + ", ordinal int"
    for i, rows in enumerate([[(1, day(0), 5, 0)], [(1, day(0), 3, 0), (1, day(1), 8, 1)]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        increments.overlap_stream(source, store, "tpe", "player_id", "task_date", "ordinal", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.task_date, r.total_tpe) for r in store.read("tpe").collect()) == [(day(0), 3), (day(1), 8)]


def test_settled_screens(spark):
    a, b = 0, 2**40 - 1
    frames = [a, a, a, b, a, b, b, b | 1 << 60, a, a]
    out, last, candidate = screens.settle(enumerate(frames))
    assert out == [1, 5, 9] and last == a and candidate is None
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate(frames)], "source string, ordinal long, hash long")
    assert sorted(r.ordinal for r in screens.settled(df).collect()) == [1, 5, 9]


def test_settled_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "source string, ordinal long, hash long"
    for rows in ([("s", 0, 7)], [("s", 1, 7), ("s", 2, 7)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        frames = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = screens.settled_stream(frames).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [r.ordinal for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_version_cache(spark):
    version = ["a"]
    cache = increments.VersionCache(lambda: version[0])
    first = cache.get("x", lambda: spark.range(1))
    assert cache.get("x", lambda: spark.range(2)) is first
    version[0] = "b"
    assert cache.get("x", lambda: spark.range(2)).count() == 2


def test_cache_lifetimes_once_and_schedule(spark):
    now, version = [0.0], [None]
    cache = increments.VersionCache(lambda: version[0], clock=lambda: now[0])
    first = cache.get("x", lambda: spark.range(1))
    now[0] = 59
    assert cache.get("x", lambda: spark.range(2)) is first
    now[0] = 61
    second = cache.get("x", lambda: spark.range(2))
    assert second.count() == 2
    version[0] = "v"
    third = cache.get("x", lambda: spark.range(3))
    now[0] += 12 * 3600 - 1
    assert cache.get("x", lambda: spark.range(4)) is third
    now[0] += 1
    assert cache.get("x", lambda: spark.range(4)).count() == 4
    ran, once = [], increments.Once()
    assert [once.run(lambda: ran.append(1)) for _ in range(3)] == [True, False, False] and ran == [1]
    clock, starts = [0.0], []

    def action():
        starts.append(clock[0])
        clock[0] += 25 if len(starts) == 1 else 1

    increments.every(10, action, 3, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    assert starts == [0.0, 30.0, 40.0]
