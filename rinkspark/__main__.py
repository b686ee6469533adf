"""Command line: ``python -m rinkspark flows | run | export | ratings``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from rinkspark.api import Rink
from rinkspark.functions.codecs import game_ending
from rinkspark.functions.elo import SEASON, STANDARD, inverted, score_share, win_draw_loss, win_loss_overtime
from rinkspark.operators import rating
from rinkspark.plans import flows
from rinkspark.session import session
from rinkspark.sources import writers



def _overtime(two_point: bool):
    def both(g):
        regulation = game_ending(g["played"], g["overtime"], g["shootout"]) == "Regulation"
        return tuple(win_loss_overtime(g["home_score"], g["away_score"], regulation, two_point, other) for other in (False, True))

    return both


def _summing(score):
    return lambda g: (score(g["home_score"], g["away_score"]), inverted(score(g["home_score"], g["away_score"])))


#: Scores of the home and the away side.
_SCORES = {"win-draw-loss": _summing(win_draw_loss), "overtime": _overtime(False), "two-point": _overtime(True), "share": _summing(score_share)}


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rinkspark")
    out.add_argument("--master", default="local[*]")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("flows", help="list the flows")
    run = commands.add_parser("run", help="run a flow")
    run.add_argument("flow")
    run.add_argument("--input")
    run.add_argument("--out")
    run.add_argument("arguments", nargs="*", metavar="key=value")
    export = commands.add_parser("export", help="write players as CSV or JSON, by the file's extension")
    export.add_argument("tables")
    export.add_argument("file")
    export.add_argument("--positions")
    export.add_argument("--norm", choices=("none", "l1", "l2"), default="none")
    export.add_argument("--attributes")
    export.add_argument("--pretty", action="store_true")
    ratings = commands.add_parser("ratings", help="rate the teams of seasons")
    ratings.add_argument("tables")
    ratings.add_argument("seasons", type=int, nargs="+")
    ratings.add_argument("--league", required=True)
    ratings.add_argument("--score", choices=sorted(_SCORES), default="win-draw-loss")
    ratings.add_argument("--strategy", choices=("standard", "season"), default="standard")
    ratings.add_argument("--format", choices=("csv", "parquet"), default="csv")
    ratings.add_argument("--output", required=True)
    return out


def _ratings(rink: Rink, a: argparse.Namespace) -> None:
    for season in a.seasons:
        games, teams = rink.leagues.ratings_input(a.league, season)
        # games of one date keep the order of their ids
        games = games.withColumn("ordinal", F.coalesce(F.col("game_id"), F.lit(0)))
        home, away = _SCORES[a.score](games)
        games = games.withColumns({"score": home, "away_score": away})
        rated = rating.season_ratings(games, teams, SEASON if a.strategy == "season" else STANDARD)
        if a.format == "parquet":
            writers.write_seasons(rated, a.output)
            continue
        names = [r.abbreviation for r in teams.select("abbreviation").distinct().orderBy("abbreviation").collect()]
        writers.write_csv(rating.wide(rated, teams, names).drop("games_played"), a.output.replace("{season}", str(season)) if "{season}" in a.output else f"{a.output}.{season}.csv")


def main(arguments: list[str]) -> int:
    a = _parser().parse_args(arguments)
    registry = flows.registry()
    if a.command == "flows":
        for name, about in registry.listed():
            print(f"{name}\t{about}")
        return 0
    spark = session(a.master)
    if a.command == "run":
        return flows.run(registry, spark, a.flow, a.arguments, a.input, a.out)
    rink = Rink(spark, a.tables)
    try:
        if a.command == "ratings":
            _ratings(rink, a)
            return 0
        players = rink.players.cards().orderBy("player_id")
        if a.attributes:
            players = flows.export_players(rink.players.cards(), a.positions, a.norm, a.attributes)
        elif a.positions:
            players = players.where(F.col("position").isin(flows.position_filter(a.positions)))
        if a.file.lower().endswith(".json"):
            writers.write_json(players, a.file, a.pretty)
        else:
            writers.export_csv(players.withColumn("_n", F.col("player_id")), a.file, "_n")
        return 0
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
