import datetime

import pytest

from rinkspark import schemas
from rinkspark.api import PlayerSearch, Rink

DAY = datetime.datetime(2022, 1, 1)


@pytest.fixture(scope="module")
def rink(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("league")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))

    columns = [c.split()[0] for c in "player_id user_id username creation_time name position status handedness current_league draft_season total_tpe bank_balance iihf_nation inactive is_suspended recruiter".split()]
    types = dict(zip(columns, "int int string timestamp string int int int int int int int string boolean boolean string".split()))
    people = [
        ("Ann", 1, 4, 2, 0, 0, 70, 500, 10, "Sweden", False, False, None),
        ("Ben", 2, 0, 2, 1, 1, 71, 300, 20, None, True, False, "ann"),
        ("ann2", 1, 5, 3, 0, None, None, 700, 0, "Norway", False, True, None),
        ("Cid", 3, 1, 0, 0, 0, 70, 500, 5, "Sweden", False, False, "ANN"),
    ]
    rows = [(1001 + i, u, f"user{u}", DAY + datetime.timedelta(days=11 * i), n, p, s, h, lg, d, t, b, nat, ina, sus, rec) for i, (n, u, p, s, h, lg, d, t, b, nat, ina, sus, rec) in enumerate(people)]
    write("player_information", rows, ", ".join(f"{c} {types[c]}" for c in columns))
    write("users", [(1, "Ann", "d1"), (2, "Ben", "d2"), (3, "Cid", None)], schemas.USERS)
    write("tpe_events", [(1001, DAY, 5), (1001, DAY + datetime.timedelta(9), 9), (1002, DAY + datetime.timedelta(30), 4)], schemas.TPE_EVENTS)
    write("leagues", [(0, "First League", "FL")], schemas.LEAGUES)
    write("seasons", [(0, 71), (0, 72)], schemas.SEASONS)
    write("conferences", [(1, 0, 72, "East"), (1, 0, 71, "East")], schemas.CONFERENCES)
    write("divisions", [(1, 72, 0, 1, "North")], schemas.DIVISIONS)
    teams = [(10, s, 0, "BUF", n, "B", None, None, None, 1 if s == 72 else None, 1) for s, n in ((71, "Old"), (72, "New"))]
    write("teams", teams, schemas.TEAMS)
    return Rink(spark, str(path))


def _names(pair):
    page, total = pair
    rows = [r.name for r in page.collect()]
    return rows, total.first().total


def test_player_search(rink):
    find = lambda **q: _names(rink.players.search(PlayerSearch(**q)))
    assert find() == (["Ann", "Ben", "Cid", "ann2"], 4)
    assert find(text=" aNN ") == (["Ann", "ann2"], 2)
    assert find(text="USER2") == (["Ben"], 1)
    assert find(positions=("LW", "?")) == (["ann2"], 1) and find(positions=("?",))[1] == 4
    assert find(leagues=(0,)) == (["Ann", "Cid"], 2)
    assert find(nation="swe", suspended=False) == (["Ann", "Cid"], 2)
    assert find(recreate=True) == (["ann2"], 1) and find(recreate=False)[1] == 3
    assert find(total_tpe=(400, 600), bank_balance=(None, 5)) == (["Cid"], 1)
    assert find(sort_by="total_tpe", descending=True, page=1, page_size=3)[0] == ["ann2", "Ann", "Cid"]
    assert find(sort_by="league")[0] == ["ann2", "Ann", "Cid", "Ben"]
    with pytest.raises(ValueError):
        find(sort_by="shoe_size")
    page, _ = rink.players.search(PlayerSearch(text="ann"))
    assert [r.recreate for r in page.collect()] == [False, True]


def test_player_lookups(rink):
    assert [r.name for r in rink.players.by_ids([1003, 1001, 9]).collect()] == ["Ann", "ann2"]
    assert [r.outcome for r in rink.players.resolve([1001], ["BEN", "who"]).orderBy("ordinal").collect()] == ["found", "found", "not_found"]
    assert [r.total_tpe for r in rink.players.timeline(1001).collect()] == [5, 9]
    assert rink.players.timeline(1004).count() == 0
    assert [r.name for r in rink.players.autocomplete("an", 5).collect()] == ["Ann", "ann2"]
    _, long, lines = rink.players.compared([1001, 1002], ["total_tpe"])
    assert long.count() == 2 and lines.where("player_id = 1002").first().aligned == DAY


def test_users(rink):
    assert [(r.player, r.discord_id) for r in rink.users.get("1").collect()] == [("ann2", None), ("Ann", None)]
    assert rink.users.get("Ben", private=True).first().discord_id == "d2"
    assert _names(rink.users.search("d2", private=True, by_discord=True)) == (["Ben"], 1)
    assert _names(rink.users.search("d2")) == ([], 0)


def test_leagues(rink):
    assert rink.leagues.seasons().first().seasons == [72, 71]
    assert rink.leagues.current_seasons().first().season == 72
    card = rink.leagues.team("fl", "buf").first()
    assert (card.name, card.division) == ("New", "North")
    old = rink.leagues.team("FL", "BUF", 71).first()
    assert (old.name, old.division) == ("Old", None)
    with pytest.raises(ValueError):
        rink.leagues.ratings_input("second league", 72)


def test_recruitment(rink):
    rows = rink.recruitment.recruiters(category=0).collect()
    assert [(r.recruiter_key, r.users, r.lineage_users) for r in rows] == [("Ann", 2, 2)]
    tally, recruits = rink.recruitment.recruiter("aNN")
    assert tally.count() == 1 and [r.username for r in recruits.collect()] == ["user2", "user3"]
    assert rink.recruitment.lineage("ann").count() == 2
    rink.recruitment.refresh()


def test_command_line(rink, tmp_path, capsys):
    import json

    from rinkspark.__main__ import main

    assert main(["flows"]) == 0 and "recruitment" in capsys.readouterr().out
    assert main(["export", rink.path, str(tmp_path / "p.json"), "--positions", "C,LW"]) == 0
    assert [p["name"] for p in json.loads((tmp_path / "p.json").read_text())] == ["Ann", "ann2"]
    assert main(["export", rink.path, str(tmp_path / "p.csv")]) == 0
    head = (tmp_path / "p.csv").read_text("utf-8-sig").splitlines()[0].split(",")
    assert "name" in head and "_n" not in head
    assert main(["export", rink.path, str(tmp_path / "x.csv"), "--positions", "Q"]) == 1
    assert main(["ratings", rink.path, "72", "--league", "nobody", "--output", str(tmp_path / "r")]) == 1


def test_rating_files(rink, spark, tmp_path):
    from rinkspark.__main__ import main

    path = rink.path
    games = [("s1", 1, 72, 0, DAY.date(), 10, 11, 3, 1, True, False, False, 2), ("s2", 2, 72, 0, DAY.date(), 11, 10, 2, 1, True, True, False, 2)]
    spark.createDataFrame(games, schemas.GAMES).write.mode("overwrite").parquet(f"{path}/game_results.parquet")
    for league in ("first LEAGUE",):
        assert main(["ratings", path, "72", "--league", league, "--score", "overtime", "--output", str(tmp_path / "r-{season}.csv")]) == 0
        assert main(["ratings", path, "72", "--league", league, "--format", "parquet", "--output", str(tmp_path / "r")]) == 0
    assert (tmp_path / "r-72.csv").read_text("utf-8-sig").splitlines()[:3] == ["BUF", "1000", "1050"]
    assert spark.read.parquet(str(tmp_path / "r")).where("season = 72").count() == 5
