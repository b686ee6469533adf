import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkspark.operators import clusters, export, latest, lookup, merge, ranklist, rating, recruitment, search, templates

DAY = datetime.datetime(2020, 1, 1)


def test_position_filter():
    assert search.position_filter("F") == [4, 5, 6] and search.position_filter("d, G,g") == [1, 2, 0]
    assert search.position_filter("  ") is None
    with pytest.raises(ValueError, match="XX, Q"):
        search.position_filter("C,XX,Q")
    assert search.positions("p", ["XX"]) is None


def test_pages_are_clamped(spark):
    df = spark.range(250).orderBy("id")
    assert [r.id for r in search.page(df, 0, 500).collect()] == list(range(100))
    assert [r.id for r in search.page(df, 3, 2).collect()] == [4, 5]


def test_query_strings():
    defaults = {"status": ["Active"]}
    assert search.from_query_string("?Name=x&pos=C&pos=LW", defaults) == {"status": ["Active"], "name": ["x"], "pos": ["C", "LW"]}
    assert search.from_query_string("STATUS=all", defaults)["status"] == []


def _players(spark, rows):
    made = [(u, n, p, DAY + datetime.timedelta(days=p), r, t) for u, n, p, r, t in rows]
    return spark.createDataFrame(made, "user_id int, username string, player_id int, creation_time timestamp, recruiter string, latest_tpe long")


def _members(spark, *names):
    return spark.createDataFrame(list(zip(names, range(len(names)))), "name string, ordinal int")


def _edges(spark, rows, *names):
    return recruitment.classified(recruitment.consolidated(_players(spark, rows)), _members(spark, *names))


@pytest.mark.parametrize(("raw", "want"), [("gRETZky", (0, "Gretzky")), ("  MYSELF  ", (2, "Myself")), (None, (3, "")), ("   ", (3, "")), ("  Google ", (1, "Google"))])
def test_classification(spark, raw, want):
    row = _edges(spark, [(1, "x", 1, raw, 1)], "Gretzky", "GRETZKY").first()
    assert (row.category, row.recruiter_key) == want


def test_consolidation_takes_the_earliest_player(spark):
    rows = [(1, "late", 20, "Reddit", 300), (1, "early", 10, "Gretzky", 500)]
    assert tuple(recruitment.consolidated(_players(spark, rows)).first()) == (1, "early", "Gretzky", 800)


def test_lineage_counts_each_member_once(spark):
    rows = [(1, "Root", 1, "Google", 100), (2, "Mid", 2, "root", 200), (3, "Leaf", 3, "MID", 400)]
    edges = _edges(spark, rows, "Root", "Mid", "Leaf")
    got = {r.recruiter_key: (r.users, r.tpe, r.lineage_users, r.lineage_tpe) for r in recruitment.tallies(edges, recruitment.lineage(edges)).collect()}
    assert got == {"Google": (1, 100, 3, 700), "Root": (1, 200, 2, 600), "Mid": (1, 400, 1, 400)}
    tree = {r.user_id: (r.parent_id, r.depth, r.subtree_users, r.subtree_tpe) for r in recruitment.tree(edges, "google").collect()}
    assert tree == {1: (None, 1, 3, 700), 2: (1, 2, 2, 600), 3: (2, 3, 1, 400)}
    assert {r.user_id for r in recruitment.tree(edges, "google", 2).collect()} == {1, 2}


def test_lineage_on_a_cycle_reaches_its_own_root(spark):
    edges = _edges(spark, [(1, "a", 1, "c", 1), (2, "b", 2, "a", 1), (3, "c", 3, "b", 1)], "a", "b", "c")
    assert {r.lineage_users for r in recruitment.tallies(edges, recruitment.lineage(edges)).collect()} == {3}


def test_recruiter_order_and_summary(spark):
    rows = [(1, "a", 1, "Google", 100), (2, "b", 2, "Google", 100), (3, "c", 3, "Reddit", 5000), (4, "d", 4, "myself", 300), (5, "e", 5, None, 400)]
    t = recruitment.tallies(_edges(spark, rows, "zz"))
    assert recruitment.in_order(t).first().recruiter_key == "Google"
    assert [tuple(r) for r in recruitment.summary(t).collect()] == [(1, 2, 3, 5200), (2, 1, 1, 300), (3, 1, 1, 400)]


def test_lookup_outcomes(spark):
    table = spark.createDataFrame([(1, "Al"), (2, "al"), (3, "Bo")], "player_id int, name string")
    wanted = lookup.requests(spark, [3, 9, 3], [" AL ", "bo", "", "zed"])
    got = [(r.id, r.name, r.outcome, r.ids) for r in lookup.resolve(wanted, table, "player_id", "name").orderBy("ordinal").collect()]
    assert got == [(3, None, "found", [3]), (9, None, "not_found", []), (None, "AL", "ambiguous", [1, 2]), (None, "bo", "found", [3]), (None, "zed", "not_found", [])]
    with pytest.raises(ValueError):
        lookup.requests(spark, list(range(201)), [])


def _board(spark, rows):
    return spark.createDataFrame(rows, "board_id int, player_id int, status string, rank int, assigned_to string")


def _ranks(df):
    return {r.player_id: r.rank for r in df.collect()}


def test_board_moves(spark):
    board = _board(spark, [(1, 10, "Pending", 1, None), (1, 11, "Pending", 2, None), (1, 12, "Pending", 3, None), (1, 13, "Rejected", 0, None)])
    assert _ranks(ranklist.moved(board, 1, 1, 3)) == {10: 3, 11: 1, 12: 2, 13: 0}
    assert _ranks(ranklist.moved(board, 1, 3, 1, 12)) == {10: 2, 11: 3, 12: 1, 13: 0}
    assert _ranks(ranklist.moved_within(board, 1, 10, 99)) == {10: 3, 11: 1, 12: 2, 13: 0}
    for bad in ((0, 1), (1, 4)):
        with pytest.raises(ranklist.Conflict):
            ranklist.moved(board, 1, *bad)
    with pytest.raises(ranklist.Conflict):
        ranklist.moved(board, 1, 1, 2, 99)


def test_board_changes(spark):
    board = _board(spark, [(1, 10, "Pending", 1, "me"), (1, 11, "Pending", 2, None), (1, 12, "Rejected", 0, None)])
    assert _ranks(ranklist.added(board, 1, 9)) == {10: 1, 11: 2, 12: 0, 9: 3}
    with pytest.raises(ranklist.Conflict):
        ranklist.added(board, 1, 10)
    assert _ranks(ranklist.removed(board, board.where("player_id = 10"))) == {11: 1, 12: 0}
    change = spark.createDataFrame([(1, 10, "Rejected", ""), (1, 12, "Pending", "you")], "board_id int, player_id int, status string, assigned_to string")
    got = {r.player_id: (r.rank, r.assigned_to) for r in ranklist.updated(board, change).collect()}
    assert got == {10: (0, None), 11: (1, None), 12: (2, "you")}


def test_bulk_add(spark):
    board = _board(spark, [(1, 10, "Pending", 1, None)])
    players = spark.createDataFrame([(10, "Al"), (11, "Bo"), (12, "bo"), (13, "Cy")], "id int, name string")
    after, report = ranklist.bulk_added(board, 1, lookup.requests(spark, [13, 10, 99], ["cy", "Al", "nobody"]), players, "id", "name")
    assert _ranks(after) == {10: 1, 13: 2}
    assert [r.outcome for r in report.orderBy("ordinal").collect()] == ["added", "already", "not_found", "added", "already", "not_found"]
    with pytest.raises(ranklist.Conflict):
        ranklist.bulk_added(board, 1, lookup.requests(spark, [], ["BO"]), players, "id", "name")


def test_merge_and_history(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 3)], "k int, v string, w int")
    source = spark.createDataFrame([(2, "b", None), (3, "c", 3), (4, "d", 4)], "k int, v string, w int")
    result = merge.merged(target, source, ["k"])
    assert sorted(tuple(r) for r in result.select("k", "change").collect()) == [(1, "none"), (2, "updated"), (3, "none"), (4, "inserted")]
    assert merge.merged(target, source, ["k"], ["v"]).where("k = 2").first().w == 2
    start, at = F.lit("2020-01-01").cast("timestamp"), F.lit("2021-01-01").cast("timestamp")
    current = target.withColumn("valid_from", start).withColumn("valid_to", F.lit(merge.FOREVER).cast("timestamp"))
    now, old = merge.with_history(current, current.limit(0), result, ["k"], at)
    assert [(r.k, r.w) for r in old.collect()] == [(2, 2)]
    then = merge.as_of(now, old, F.lit("2020-06-01").cast("timestamp"))
    assert sorted((r.k, r.w) for r in then.collect() if r.k == 2) == [(2, 2)]
    assert {r.k for r in then.collect()} == {1, 2, 3}


def test_store_publishes_all_or_nothing(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "store"))
    assert store.read("a") is None
    merge.in_stages(store, [("a", lambda t: spark.range(3)), ("b", lambda t: t["a"].where("id > 0"))])
    assert store.read("a").count() == 3 and store.read("b").count() == 2
    with pytest.raises(ZeroDivisionError):
        merge.in_stages(store, [("a", lambda t: spark.range(9)), ("b", lambda t: 1 / 0)])
    assert store.read("a").count() == 3
    store.publish({"b": spark.range(1)})
    assert store.read("a").count() == 3 and store.read("b").count() == 1


def test_timelines(spark):
    rows = [(1, DAY, 10), (1, DAY + datetime.timedelta(days=2), 5), (2, DAY + datetime.timedelta(days=9), 1)]
    df = spark.createDataFrame(rows, "p int, t timestamp, v int")
    assert {(r.p, r.v) for r in latest.value_at(df, ["p"], "t", F.lit(DAY + datetime.timedelta(days=1))).collect()} == {(1, 10)}
    assert {r.aligned for r in latest.aligned(df, ["p"], "t").where("v = 1 or v = 10").collect()} == {DAY}


def test_kmeans_and_medoids(spark):
    rows = [(str(i), float(a), float(b)) for i, (a, b) in enumerate([(1, 1), (2, 1), (1, 2), (20, 20), (19, 20), (20, 19)])]
    df = spark.createDataFrame(rows, "id string, `s.a` double, `s.b` double")
    assert clusters.feature_columns(df, "s.") == ["s.a", "s.b"]
    good, bad = clusters.vectors(df, ["s.a", "s.b"])
    assert bad.count() == 0
    best = clusters.medoids(clusters.clustered(good, 2, 1), 2, "id", 2).collect()
    assert sorted(r.members for r in best) == [3, 3] and {r.medoid for r in best} <= {r[0] for r in rows}
    three = spark.createDataFrame([("1", [2.0, 2.0]), ("2", [4.0, 4.0]), ("3", [6.0, 6.0])], "id string, features array<float>")
    r = clusters.medoids(three.withColumn("cluster", F.lit(1)), 2, "id", 2).orderBy("cluster").collect()
    assert (r[0].centroid, r[0].members, r[0].medoid, r[1].members, r[1].medoid) == ([4.0, 4.0], 3, "2", 0, None)


def test_templates(spark):
    t = spark.createDataFrame([(0, "1", [0b1111]), (1, "1", [0b0111]), (2, "7", [0b110000])], "ordinal int, label string, words array<long>")
    got = {r.id: r for r in templates.nearest(spark.createDataFrame([(1, [0b1110]), (2, [0b111100])], "id int, words array<long>"), t, "id", 20).collect()}
    assert (got[1].label, got[1].score, got[1].confident) == ("1", 0.05, True)
    assert (got[2].label, got[2].score, got[2].other) == ("7", 0.1, 0.2)
    sure = templates.nearest(spark.createDataFrame([(1, [0b111100])], "id int, words array<long>"), t, "id", 20, margin=0.2).first()
    assert not sure.confident
    kept = templates.thinned(t, 1).collect()
    assert sorted(r.ordinal for r in kept) == [0, 2]
    one = {r.label: r for r in templates.evaluation(templates.leave_one_out(t, 20)).collect()}
    assert one["1"].accuracy == 1 and one["7"].single and one["7"].mean_same is None


def test_segmentation(spark):
    picture = ["0110000100", "0110000100", "0110100100", "0000000000"]
    glyphs = templates.segments(np.array([list(map(int, r)) for r in picture], bool))
    assert [g.shape for g in glyphs] == [(3, 2), (3, 1)]
    rows = templates.segmented(spark.createDataFrame([("a", picture), ("b", None)], "k string, px array<string>"), "k", "px").collect()
    assert [(r.k, r.place, len(r.bits)) for r in rows] == [("a", 0, 240), ("a", 1, 240)]
    ink = templates.white_text(np.full((10, 5, 3), 200, np.uint8))
    assert ink.shape == (42, 27) and ink.sum() == 10 * 5 * 9


def test_season_ratings(spark):
    games = spark.createDataFrame([(0, 1, DAY, 2, 2, 1, 0.0, True), (0, 1, DAY, 1, 1, 2, 1.0, True), (0, 1, DAY, 3, 1, 2, 1.0, False)], "league_id int, season int, sim_date timestamp, ordinal int, home_team_id long, away_team_id long, score double, played boolean")
    teams = spark.createDataFrame([(0, 1, i) for i in (1, 2, 3)], "league_id int, season int, team_id long")
    got = sorted((r.team_id, r.games_played, r.rating) for r in rating.season_ratings(games, teams).collect())
    assert got[:2] == [(1, 0, 1000), (1, 1, 1050)] and (2, 1, 950) in got and (3, 0, 1000) in got and len(got) == 7
    assert [r.rating for r in rating.season_ratings(games, teams).where("team_id = 1 and games_played = 2").collect()] == [1085]


def test_export_shapes(spark):
    df = spark.createDataFrame([(1, (None, 2), [1, 2]), (2, (3, 4), None)], "n int, s struct<a:int,b:int>, l array<int>")
    flat = export.flattened(df)
    assert flat.columns == ["n", "s.a", "s.b", "l"]
    assert export.seen_columns(flat, "n") == ["s.b", "l", "s.a"]
    assert [r.label for r in export.unpivoted(df.select("n", F.col("n").alias("topSpeed")), ["n"], ["topSpeed"]).collect()] == ["Top Speed"] * 2


def test_store_merges_touched_buckets_and_refuses_a_second_writer(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "merged"))
    rows = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    first = {r.change: r.n for r in store.merge("t", rows([(i, "a") for i in range(40)]), ["k"], buckets=4).collect()}
    assert first == {"inserted": 40}
    before = store._tables(store.versions()[-1])["t"]
    counts = {r.change: r.n for r in store.merge("t", rows([(3, "b"), (99, "c")]), ["k"]).collect()}
    after = store._tables(store.versions()[-1])["t"]
    assert counts["updated"] == 1 and counts["inserted"] == 1
    assert 2 <= sum(before[b] == after[b] for b in before)  # untouched buckets and their number stay
    got = {r.k: r.v for r in store.read("t").collect()}
    assert got == {i: "b" if i == 3 else "a" for i in range(40)} | {99: "c"}
    assert {r.k: r.v for r in store.read("t", 1).collect()} == {i: "a" for i in range(40)}
    stale = store.versions()[-1] - 1
    with pytest.raises(merge.Conflict):
        store._move(stale, {})
    assert store.versions() == [1, 2]
    store.prune(1)
    assert store.versions() == [2] and store.read("t").count() == 41


def test_hot_owner_flags_need_no_window(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 4, 11), (None, 1, 12), (None, 1, 13), (2, 1, 14)], "owner int, created int, id int")
    out = latest.with_recreate(df, "owner", "created", "id")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.recreate for r in out.collect()} == {10: True, 11: False, 12: False, 13: True, 14: False}


def test_ratings_of_outcomes_that_do_not_sum_to_one(spark):
    games = spark.createDataFrame([(0, 1, 1, 1, 7, 8, 0.666, 0.333, True)], "league_id int, season int, sim_date int, ordinal long, home_team_id long, away_team_id long, score double, away_score double, played boolean")
    teams = spark.createDataFrame([(0, 1, 7), (0, 1, 8)], "league_id int, season int, team_id long")
    got = {r.team_id: r.rating for r in rating.season_ratings(games, teams).where("games_played = 1").collect()}
    assert got == {7: 1016, 8: 983}


def test_query_strings_both_ways():
    defaults = {"status": ["2"], "page": ["1"]}
    values = {"status": [], "page": ["1"], "name": ["a b"], "position": ["C", "LW"]}
    text = search.to_query_string(values, defaults)
    assert text == "status=all&name=a+b&position=C&position=LW"
    assert search.from_query_string(text, defaults) == values


def test_comments_after_edits(spark):
    comments = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, 6, "c")], "comment_id int, author_id int, text string")
    judged = spark.createDataFrame([(1, 5, "A", "edit", True), (2, 5, None, "delete", True), (3, 5, "no", "edit", False), (4, 5, "d", "add", True)], "comment_id int, user_id int, text string, action string, allowed boolean")
    assert sorted(map(tuple, ranklist.applied_comments(comments, judged).collect())) == [(1, 5, "A"), (3, 6, "c"), (4, 5, "d")]
