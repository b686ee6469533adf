"""League queries: seasons, team cards, games with both teams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seasons(of_seasons: DataFrame) -> DataFrame:
    """(league_id, seasons): distinct, newest first."""
    return of_seasons.groupBy("league_id").agg(F.sort_array(F.collect_set("season"), asc=False).alias("seasons"))


def current_seasons(of_seasons: DataFrame) -> DataFrame:
    return of_seasons.groupBy("league_id").agg(F.max("season").alias("season"))


def last_season(of_seasons: DataFrame, season: str = "season") -> DataFrame:
    """One row: the latest season, null of an empty table."""
    return of_seasons.agg(F.max(season).alias("season"))


def team_rows(teams: DataFrame, conferences: DataFrame, divisions: DataFrame, of_seasons: DataFrame, leagues: DataFrame) -> DataFrame:
    """Teams with what they belong to: a conference always, a division where there is one."""
    out = teams.join(conferences.withColumnRenamed("name", "conference"), ["conference_id", "league_id", "season"])
    out = out.join(divisions.select("division_id", "season", "league_id", "conference_id", F.col("name").alias("division")), ["division_id", "season", "league_id", "conference_id"], "left")
    named = of_seasons.join(leagues.select("league_id", F.col("abbreviation").alias("league")), "league_id")
    return out.join(named, ["league_id", "season"])


def team_card(rows: DataFrame, league: str, abbreviation: str, season: int | None = None) -> DataFrame:
    """The team's row of one season, or of its latest."""
    found = rows.where((F.lower("league") == league.lower()) & (F.lower("abbreviation") == abbreviation.lower()))
    found = found if season is None else found.where(F.col("season") == season)
    return found.orderBy(F.col("season").desc(), "team_id").limit(1)


def games_with_teams(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Games with the names of both teams; the planner broadcasts teams while they are small."""
    side = lambda who: teams.select("league_id", "season", F.col("team_id").alias(f"{who}_team_id"), F.col("name").alias(f"{who}_team"))
    return games.join(side("home"), ["league_id", "season", "home_team_id"]).join(side("away"), ["league_id", "season", "away_team_id"])
