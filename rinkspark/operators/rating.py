"""Season ratings: a fold over games in order, with the state of all teams of a season."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.elo import FLOOR, STANDARD, START, Strategy

_RATED = "league_id int, season int, team_id long, games_played int, rating int"
#: Rows that a task hands on at once.
ROWS = 20_000


def _folded(strategy: Strategy) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ratings after each game of seasons that come one after another, each in order; a season's teams are all that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                out = [[] for _ in range(5)]
                games = batch.slice(lo, ROWS)
                for league, season, home, away, score, away_score in zip(*(c.to_pylist() for c in games.columns)):
                    if now != (league, season):
                        now, state = (league, season), {}
                    (a, n), (b, m) = state.get(home, (START, 0)), state.get(away, (START, 0))
                    share = 1 / (1 + 10 ** ((b - a) / strategy.scale))
                    up = int(math.trunc(max(a + strategy.factor(a, n) * (score - share), FLOOR)))
                    down = int(math.trunc(max(b + strategy.factor(b, m) * (away_score - (1 - share)), FLOOR)))
                    state[home], state[away] = (up, n + 1), (down, m + 1)
                    for column, pair in zip(out, ((league, league), (season, season), (home, away), (n + 1, m + 1), (up, down))):
                        column += pair
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["league_id", "season", "team_id", "games_played", "rating"])

    return run


def season_ratings(games: DataFrame, teams: DataFrame, strategy: Strategy = STANDARD) -> DataFrame:
    """(league_id, season, team_id, games_played, rating), each team's start included.

    Takes ``games(league_id, season, sim_date, ordinal, home_team_id, away_team_id, score, played)``,
    ``score`` the home side's outcome, and ``teams(league_id, season, team_id)``. ``away_score`` is the
    away side's, the rest to one where the games have none. A game moves both teams from their ratings
    before it, so a season is folded in order and seasons are independent. Spark sorts a season's games;
    they pass the fold as a stream, which holds the season's teams and a batch of games.
    """
    games = games if "away_score" in games.columns else games.withColumn("away_score", 1 - F.col("score"))
    by = ["league_id", "season"]
    order = [*by, F.asc_nulls_last("sim_date"), F.asc_nulls_last("ordinal")]
    kinds = [F.col(c).cast("int").alias(c) for c in by] + [F.col(c).cast("long").alias(c) for c in ("home_team_id", "away_team_id")] + [F.col(c).cast("double").alias(c) for c in ("score", "away_score")]
    played = games.where("played").repartition(*by).sortWithinPartitions(*order).select(*kinds)
    start = teams.select(*(F.col(c).cast("int").alias(c) for c in by), F.col("team_id").cast("long").alias("team_id")).distinct()
    start = start.select("*", F.lit(0).alias("games_played"), F.lit(START).alias("rating"))
    return start.unionByName(played.mapInArrow(_folded(strategy), _RATED))


def wide(ratings: DataFrame, teams: DataFrame, abbreviations: list[str]) -> DataFrame:
    """One column a team, one row a number of games; blank past a team's last game. One season."""
    named = ratings.join(teams.select("league_id", "season", "team_id", "abbreviation"), ["league_id", "season", "team_id"])
    return named.groupBy("games_played").pivot("abbreviation", abbreviations).agg(F.first("rating")).orderBy("games_played")
