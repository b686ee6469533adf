import json
import struct

import pytest
from pyspark.sql import functions as F

from rinkspark.plans import flows
from rinkspark.session import Dataset
from rinkspark.sources import csv_in, files, rest, savefile, writers


def test_csv_in(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿playerId,name\n1,\n2,x,extra\n3\n", encoding="utf-8")
    df = csv_in.read_csv(spark, str(path))
    assert df.columns == ["playerId", "name"]
    assert [tuple(r) for r in df.collect()] == [("1", None), ("2", "x"), ("3", None)]
    with pytest.raises(FileNotFoundError):
        csv_in.read_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        csv_in.read_csv(spark, str(tmp_path / "empty.csv"))


def test_csv_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"'), (2, None)], "n int, t string").orderBy("n")
    writers.write_csv(df, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes() == '﻿n,t\r\n1,"a ""b"""\r\n2,\r\n'.encode()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, (None, 1)), (1, (5, None))], "n int, s struct<a:int,b:int>")
    writers.export_csv(df, str(tmp_path / "e.csv"), "n")
    assert (tmp_path / "e.csv").read_text("utf-8-sig").splitlines() == ["s.a,s.b", "5,", ",1"]
    writers.write_json(df.orderBy("n"), str(tmp_path / "e.json"), pretty=True)
    assert json.loads((tmp_path / "e.json").read_text())[0] == {"n": 1, "s": {"a": 5, "b": None}}


def test_json_is_written_by_tasks_or_not_at_all(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('é",\n'), "id")).alias("t")).repartitionByRange(7, "n").sortWithinPartitions("n")
    want = [{"n": i, "t": f'é",\n{i}' if i % 3 else None} for i in range(200)]
    for pretty in (False, True):
        writers.write_json(df, str(tmp_path / "a.json"), pretty)
        assert json.loads((tmp_path / "a.json").read_text("utf-8")) == want
        writers.write_json(df.limit(0), str(tmp_path / "b.json"), pretty)
        assert json.loads((tmp_path / "b.json").read_text()) == []
    broken = df.withColumn("t", F.when(F.col("n") == 150, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="broken"):
        writers.write_json(broken, str(tmp_path / "c.json"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"]


def test_stored_once(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "content_hash string, n int")
    got = writers.stored_once(new, spark.createDataFrame([("b", 0)], "content_hash string, n int"), "content_hash", ["n"]).collect()
    assert [tuple(r) for r in got] == [("a", 1)]


def test_markdown_and_templates(spark, tmp_path):
    (tmp_path / "20240102-b.md").write_text("# Beta\n\nx")
    (tmp_path / "20240102-a.md").write_text("intro\n# alpha\n")
    (tmp_path / "20240301-c.md").write_text("# Gamma")
    assert [r.title for r in files.markdown(spark, str(tmp_path)).collect()] == ["Gamma", "alpha", "Beta"]
    (tmp_path / "t.json").write_text('[{"label":"1","bits":"101"}]')
    assert [tuple(r) for r in files.templates(spark, str(tmp_path / "t.json")).collect()] == [(0, "1", [5])]
    box = spark.range(1).select(files.pixel_box(F.lit(100), F.lit(50), F.lit(0.5), F.lit(0.0), F.lit(0.9), F.lit(0.001)).alias("b")).first().b
    assert tuple(box) == (50, 0, 50, 1)


def test_rest_requests():
    urls = rest.request_urls("http://h/api/", "teams", [{"league": 0, "season": 70}, {"league": 1, "season": None}])
    assert urls == ["http://h/api/teams?league=0&season=70", "http://h/api/teams?league=1"]
    with pytest.raises(ValueError, match="colour"):
        rest.request_urls("http://h", "teams", [{"colour": 1}])


def test_rest_limits_and_retries():
    waits, now = [], [0.0]
    bucket = rest.Bucket(2, 10.0, lambda: now[0], lambda s: (waits.append(round(s, 3)), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        bucket.take()
    assert waits == [0.1, 0.1]
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert rest.retried(flaky, sleep=slept.append) == "ok" and slept == [1, 2]
    with pytest.raises(OSError):
        rest.retried(lambda: (_ for _ in ()).throw(OSError()), 2, slept.append)


def test_rest_source(spark):
    class Offline(rest.RestSource):
        get = staticmethod(lambda url: json.dumps([{"id": int(url.rpartition("=")[2]), "name": "x"}]))

        @classmethod
        def name(cls):
            return "rest_offline"

    raw = rest.load(spark, "http://h", "schedule", [{"league": 3}, {"league": 4}], Offline)
    assert sorted(r.id for r in rest.decoded(raw, "id:int,name:string").collect()) == [3, 4]


def test_save_files(spark, tmp_path):
    def string(s):
        raw = s.encode("utf-16-be")
        return struct.pack(">i", len(raw)) + raw

    (tmp_path / "names.dat").write_bytes(struct.pack(">i", 2) + struct.pack(">i", 7) + string("Åke") + struct.pack(">i", 8) + struct.pack(">i", -1))
    got = savefile.read_records(spark, str(tmp_path / "names.dat"), savefile.names, "id int, name string").collect()
    assert [tuple(r) for r in got] == [(7, "Åke"), (8, None)]


def test_flow_arguments():
    assert flows.parse_arguments(["K=3", "path=a=b"]) == {"k": "3", "path": "a=b"}
    for bad in (["k"], ["=1"], ["a=1", "A=2"]):
        with pytest.raises(flows.FlowError):
            flows.parse_arguments(bad)
    registry = flows.registry()
    assert [n for n, _ in registry.listed()] == ["kmeans-centroids", "player-summary", "recruitment"]
    with pytest.raises(flows.FlowError):
        registry.add(registry.get("RECRUITMENT"))


def test_kmeans_flow(spark, tmp_path):
    rows = ["playerId,name,skaterAttributes.checking,skaterAttributes.speed,goaltenderAttributes.glove"]
    rows += [f"{i},P{i},{a},{b}," for i, (a, b) in enumerate([(1, 1), (2, 1), (1, 2), (20, 20), (19, 20), (20, 19)])] + ["9,G,,,5", "10,H,x,1,"]
    (tmp_path / "in.csv").write_text("\n".join(rows))
    run = lambda *a: flows.run(flows.registry(), spark, "KMeans-Centroids", list(a), str(tmp_path / "in.csv"), str(tmp_path))
    assert run("k=2", "seed=1") == 0
    lines = (tmp_path / "skater-centroids.csv").read_text("utf-8-sig").splitlines()
    assert lines[0] == "cluster,members,skaterAttributes.checking,skaterAttributes.speed" and len(lines) == 3
    assert not (tmp_path / "goaltender-centroids.csv").exists()
    assert run() == 1 and run("k=0") == 1 and run("k=50") == 1
    assert flows.run(flows.registry(), spark, "nope", [], "x") == 1


def test_table_flows(spark, tmp_path):
    import datetime

    day = datetime.datetime(2020, 1, 1)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("player_information", [(1, 1, "Root", day, "Google", 0, 100), (2, 2, "Kid", day, "ROOT", 4, 200)], "player_id int, user_id int, username string, creation_time timestamp, recruiter string, position int, total_tpe int")
    write("users", [(1, "Root"), (2, "Kid")], "user_id int, name string")
    write("tpe_events", [(1, day, 50), (2, day, 70), (2, day + datetime.timedelta(1), 60)], "player_id int, task_date timestamp, total_tpe int")
    out = tmp_path / "out"
    out.mkdir()
    assert flows.run(flows.registry(), spark, "recruitment", ["top=5"], str(tmp_path), str(out)) == 0
    assert (out / "recruiters.csv").read_text("utf-8-sig").splitlines()[1:] == ["0,Root,1,60,1,60", "1,Google,1,50,2,110"]
    assert flows.run(flows.registry(), spark, "player-summary", [], str(tmp_path), str(out)) == 0
    assert (out / "summary.csv").read_text("utf-8-sig").splitlines() == ["position,players,average_tpe", "G,1,100.0", "C,1,200.0"]
    assert list(Dataset(spark, str(tmp_path))) == ["player_information", "tpe_events", "users"]


def test_export_recipe(spark):
    rows = [(i, 4 if i % 2 else 0, 300 if i != 3 else 10, [float(1 + i % 3), 5.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "player_id int, position int, total_tpe int, attributes array<double>")
    assert [r.player_id for r in flows.export_players(df, "C", "l1").collect()] == [1, 3, 5, 7]
    assert flows.centroid_recipe(df, 2, "C").agg(F.sum("members")).first()[0] == 3


def test_requests_of_a_lane_keep_its_part_of_the_rate():
    reader = rest._Reader({"urls": json.dumps([f"u{i}" for i in range(12)]), "rate": "40", "tokens": "4", "parallel": "2"}, lambda url: url)
    import time

    lanes = reader.partitions()
    assert [[u for u, _ in lane.value] for lane in lanes] == [[f"u{i}" for i in range(k, 12, 2)] for k in range(2)]
    began = time.monotonic()
    assert list(reader.read(lanes[1])) == [(f"u{i}", f"u{i}", i) for i in range(1, 12, 2)]
    assert time.monotonic() - began >= 0.19  # two at once, four at 20 a second
    assert rest.request_urls("http://h", "roster", [{"id": 7, "season": 70}]) == ["http://h/teams/7/roster?season=70"]


def test_client_errors_are_not_retried():
    import urllib.error

    calls = []

    def refused():
        calls.append(1)
        raise urllib.error.HTTPError("u", 404, "no", None, None)

    with pytest.raises(urllib.error.HTTPError):
        rest.retried(refused, sleep=lambda s: None)
    assert len(calls) == 1
