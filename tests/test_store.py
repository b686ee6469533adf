import datetime
import random

import pytest
from pyspark.sql import functions as F

from rinkspark.operators import merge
from rinkspark.streaming import increments

TPE = "player_id long, task_date timestamp, total_tpe int"
DAY = datetime.datetime(2024, 1, 1)


def _day(n, second=0):
    return DAY + datetime.timedelta(days=n, seconds=second)


def _history(spark, days, players=20):
    return spark.createDataFrame([(p, _day(d, p), d) for d in range(days) for p in range(players)], TPE)


def _files(store, name, version=None):
    return {r.file: r for r in store.files(name, version).collect()}


def test_recent_batches_rewrite_few_files(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "store"))
    order = ["task_date", "player_id"]
    store.merge_ordered("tpe", _history(spark, 200), ["player_id", "task_date"], order, rows=250)
    before = _files(store, "tpe")
    assert len(before) >= 16 and sum(r.n for r in before.values()) == 4000 and max(r.n for r in before.values()) <= 250
    recent = spark.createDataFrame([(p, _day(198, p), -1) for p in range(20)] + [(p, _day(201, p), 7) for p in range(20)], TPE)
    counts = {r.change: r.n for r in store.merge_ordered("tpe", recent, ["player_id", "task_date"], order, rows=250).collect()}
    after = _files(store, "tpe")
    assert counts["updated"] == 20 and counts["inserted"] == 20
    assert len(before.keys() - after.keys()) <= 2 and len(after.keys() - before.keys()) <= 4
    got = {(r.player_id, r.task_date): r.total_tpe for r in store.read("tpe").collect()}
    assert got == {(p, _day(d, p)): -1 if d == 198 else d for d in range(200) for p in range(20)} | {(p, _day(201, p)): 7 for p in range(20)}
    assert store.read("tpe", 1).count() == 4000
    part = store.read_between("tpe", _day(10), _day(12))
    assert part.count() == 41 and len(part.inputFiles()) <= 2  # day 12 begins with player 0
    assert store.read_between("tpe", _day(900), _day(901)).count() == 0


def test_ranges_stay_disjoint_under_any_merges(spark, tmp_path):
    store, rng, want = merge.Store(spark, str(tmp_path / "store")), random.Random(1), {}
    for _ in range(5):
        batch = {(rng.choice([None, "a", "b", "é", ""]), rng.randint(0, 60)): rng.randint(0, 3) for _ in range(60)}
        want |= batch
        rows = spark.createDataFrame([(*k, v) for k, v in batch.items()], "name string, n long, v int")
        store.merge_ordered("t", rows.where("name is not null"), ["name", "n"], ["n", "name"], rows=25)
    want = {k: v for k, v in want.items() if k[0] is not None}
    assert {(r.name, r.n): r.v for r in store.read("t").collect()} == want
    files = sorted(_files(store, "t").values(), key=lambda r: r.lo)
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(files, files[1:], strict=False)) and max(r.n for r in files) <= 25
    with pytest.raises(ValueError):
        store.merge("t", store.read("t"), ["n"])
    with pytest.raises(ValueError):
        store.merge_ordered("t", store.read("t"), ["name", "n"], ["n"])


def test_prune_spares_what_a_writer_stages(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "store"))
    for n in range(3):
        store.merge_ordered("t", spark.range(n, n + 5).withColumn("v", F.lit(n)), ["id"], ["id"], rows=4)
    change = store.change()
    change.merge_ordered("t", spark.range(2, 9).withColumn("v", F.lit(9)), ["id"], ["id"], rows=4)
    store.prune(1)
    assert store.versions() == [3]
    change.publish()
    assert {r.id: r.v for r in store.read("t").collect()} == {0: 0, 1: 1} | {i: 9 for i in range(2, 9)}
    lost = store.change()
    lost.put("u", spark.range(1))
    folders = lambda: {f.name for f in (tmp_path / "store").iterdir() if f.is_dir()}
    there = folders()
    store.prune(1, staging=-1)
    assert there - folders() >= {lost.folder.rsplit("/", 1)[1]} and store.read("t").count() == 9


def test_stream_merges_under_the_overlap_and_rewrites_recent_files(spark, tmp_path):
    store, schema = merge.Store(spark, str(tmp_path / "store")), TPE + ", ordinal int"
    rows = [[(p, _day(d, p), d, 0) for d in range(120) for p in range(5)]]
    rows += [[(1, _day(100, 1), 50, 0), (1, _day(100, 1), 51, 1), (1, _day(3, 1), 99, 0), (2, _day(120, 2), 1, 0), (9, _day(0), 1, 0)]]
    kept = []
    for batch in rows:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        increments.overlap_stream(source, store, "tpe", "player_id", "task_date", "ordinal", str(tmp_path / "cp"), rows=50).awaitTermination()
        kept.append(set(_files(store, "tpe")))
    got = {(r.player_id, r.task_date): r.total_tpe for r in store.read("tpe").collect()}
    want = {(p, _day(d, p)): d for d in range(120) for p in range(5)}
    assert got == want | {(1, _day(100, 1)): 51, (2, _day(120, 2)): 1, (9, _day(0)): 1}  # day 3 lies before the cutoff
    assert len(kept[0]) >= 12 and len(kept[0] - kept[1]) <= 3
    assert {r.player_id: r.last for r in store.read("tpe_last").collect()} == {0: _day(119), 1: _day(119, 1), 2: _day(120, 2), 3: _day(119, 3), 4: _day(119, 4), 9: _day(0)}
