"""The query surface over a folder of league tables: players, users, leagues, recruitment, boards.

Every method gives DataFrames and leaves actions to the caller; what is not there is an empty frame.
Expected tables and columns are those of ``rinkspark.schemas``, one Parquet table each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.functions.codecs import hex_colour, position_short
from rinkspark.operators import export, latest, league, lookup, ranklist, recruitment, search
from rinkspark.plans.flows import recruitment_tables
from rinkspark.session import Dataset


@dataclass(frozen=True)
class PlayerSearch:
    """Options of the player search; what is none or empty does not filter."""

    text: str | None = None
    positions: tuple[str, ...] = ()
    statuses: tuple[int, ...] = ()
    leagues: tuple[int, ...] = ()
    handedness: tuple[int, ...] = ()
    draft_season: int | None = None
    nation: str | None = None
    inactive: bool | None = None
    suspended: bool | None = None
    recreate: bool | None = None
    total_tpe: tuple[int | None, int | None] = (None, None)
    bank_balance: tuple[int | None, int | None] = (None, None)
    page: int = 1
    page_size: int = search.PAGE_SIZE
    sort_by: str = "name"
    descending: bool = False


#: What players can be sorted by, and the column of each.
PLAYER_SORTS = {"name": "name", "total_tpe": "total_tpe", "draft_season": "draft_season", "position": "position", "status": "status", "league": "current_league", "username": "username", "created": "creation_time"}
USER_SORTS = {"name": "name", "user_id": "user_id", "discord": "discord_id"}


class Players:
    def __init__(self, tables: Dataset):
        self.tables = tables

    def cards(self) -> DataFrame:
        """All players with ``recreate`` and their short position; one window a user, no self join."""
        rows = latest.with_recreate(self.tables.player_information, "user_id", "creation_time", "player_id")
        if {"skater_attributes", "goaltender_attributes"} <= set(rows.columns):
            # one view of either kind of attributes, whichever the player has
            rows = rows.withColumn("attributes", F.coalesce(F.to_json("skater_attributes"), F.to_json("goaltender_attributes")))
        return rows.withColumn("position_name", position_short(F.col("position")))

    def card(self, player_id: int) -> DataFrame:
        return self.cards().where(F.col("player_id") == player_id)

    def by_ids(self, ids: list[int]) -> DataFrame:
        return lookup.by_ids(self.cards(), "player_id", ids, ["name", "player_id"])

    def suggestions(self) -> DataFrame:
        return self.tables.player_information.select("player_id", "name", "username", "position", "status").orderBy("name", "player_id")

    def autocomplete(self, term: str | None, limit: int) -> DataFrame:
        return search.autocomplete(self.suggestions(), term, limit, "name", "username", "player_id")

    def _predicates(self, q: PlayerSearch) -> list[Column | None]:
        return [
            search.contains(["name", "username"], q.text),
            search.positions("position", q.positions),
            search.one_of("status", q.statuses),
            search.one_of("current_league", q.leagues),
            search.one_of("handedness", q.handedness),
            search.equal("draft_season", q.draft_season),
            search.contains(["iihf_nation"], q.nation),
            search.equal("inactive", q.inactive),
            search.equal("is_suspended", q.suspended),
            search.between("total_tpe", *q.total_tpe),
            search.between("bank_balance", *q.bank_balance),
        ]

    def search(self, q: PlayerSearch) -> tuple[DataFrame, DataFrame]:
        """(the page, one row with the total).

        Flags need all of a user's players, so the filters come after them only if they ask for the
        flag; otherwise they reach the scan, and the flags are made for the page alone.
        """
        if q.sort_by not in PLAYER_SORTS:
            raise ValueError(f"unknown sort: {q.sort_by}")
        key, last = PLAYER_SORTS[q.sort_by], "player_id"
        if q.recreate is not None:
            predicates = [*self._predicates(q), search.equal("recreate", q.recreate)]
            return search.search(self.cards(), predicates, key, last, q.descending, q.page, q.page_size)
        page, total = search.search(self.tables.player_information, self._predicates(q), key, last, q.descending, q.page, q.page_size)
        same_users = self.tables.player_information.join(F.broadcast(page.select("user_id").distinct()), "user_id", "left_semi")
        flags = latest.with_recreate(same_users, "user_id", "creation_time", "player_id").select("player_id", "recreate")
        cards = page.join(flags, "player_id").withColumn("position_name", position_short(F.col("position")))
        return search.ordered(cards, key, q.descending, last), total

    def resolve(self, ids: list[int], names: list[str]) -> DataFrame:
        wanted = lookup.requests(self.tables.spark, ids, names)
        return lookup.resolve(wanted, self.tables.player_information, "player_id", "name")

    def timeline(self, player_id: int) -> DataFrame:
        """(task_date, total_tpe) in order; an absent player and one without events both have none."""
        return self.tables.tpe_events.where(F.col("player_id") == player_id).select("task_date", "total_tpe").orderBy("task_date")

    def compared(self, ids: list[int], attributes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(cards, attributes as rows, timelines shifted to a common start) of several players."""
        cards = self.by_ids(ids)
        long = export.unpivoted(cards, ["player_id"], attributes)
        events = self.tables.tpe_events.where(F.col("player_id").isin(list(dict.fromkeys(ids))))
        return cards, long, latest.aligned(events, ["player_id"], "task_date")


class Users:
    def __init__(self, tables: Dataset):
        self.tables = tables

    def get(self, key: str, private: bool = False) -> DataFrame:
        """The user of an id or exact name, with ``players`` newest first."""
        user = search.gated(self.tables.users.where(search.id_or_name("user_id", "name", key)), "discord_id", private)
        return user.join(self.tables.player_information.select("user_id", "player_id", F.col("name").alias("player"), "creation_time"), "user_id", "left").orderBy(F.col("creation_time").desc(), "player_id")

    def search(self, text: str | None = None, private: bool = False, by_discord: bool = False, sort_by: str = "name", descending: bool = False, page: int = 1, page_size: int = search.PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
        """(the page, one row with the total); the private column is searched and shown only if allowed."""
        columns = ["name", "discord_id"] if private and by_discord else ["name"]
        key = USER_SORTS[sort_by] if private or sort_by != "discord" else "name"
        rows, total = search.search(self.tables.users, [search.contains(columns, text)], key, "user_id", descending, page, page_size)
        return search.gated(rows, "discord_id", private), total

    def suggestions(self) -> DataFrame:
        return self.tables.users.select("user_id", "name").orderBy("name", "user_id")

    def autocomplete(self, term: str | None, limit: int) -> DataFrame:
        return search.autocomplete(self.suggestions(), term, limit, "name", None, "user_id")


class Leagues:
    def __init__(self, tables: Dataset):
        self.tables = tables

    def seasons(self) -> DataFrame:
        return league.seasons(self.tables.seasons)

    def current_seasons(self) -> DataFrame:
        return league.current_seasons(self.tables.seasons)

    def team(self, of_league: str, abbreviation: str, season: int | None = None) -> DataFrame:
        t = self.tables
        return league.team_card(league.team_rows(t.teams, t.conferences, t.divisions, t.seasons, t.leagues), of_league, abbreviation, season)

    def ratings_input(self, of_league: str, season: int) -> tuple[DataFrame, DataFrame]:
        """(games, teams) of one league by name in any case, and season, for the season's ratings."""
        found = self.tables.leagues.where(F.lower("name") == of_league.lower()).select("league_id").collect()
        if len(found) != 1:
            raise ValueError(f"not one league: {of_league}")
        here = (F.col("league_id") == found[0].league_id) & (F.col("season") == season)
        return self.tables.game_results.where(here), self.tables.teams.where(here)

    @staticmethod
    def colours(rows: DataFrame, red: str, green: str, blue: str, name: str) -> DataFrame:
        return rows.withColumn(name, hex_colour(F.col(red), F.col(green), F.col(blue)))


class Recruitment:
    """Tallies and lineage, computed once for a version of the tables and kept."""

    def __init__(self, tables: Dataset):
        self.tables = tables
        self._held: tuple[DataFrame, DataFrame] | None = None

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        if self._held is None:
            t = self.tables
            edges, reached = recruitment_tables(t.player_information, t.users, t.tpe_events)
            edges = edges.persist()
            self._held = edges, recruitment.tallies(edges, reached).persist()
        return self._held

    def refresh(self) -> None:
        for df in self._held or ():
            df.unpersist()
        self._held = None

    def summary(self) -> DataFrame:
        return recruitment.summary(self._tables()[1])

    def recruiters(self, category: int | None = None, by: str = "users", limit: int = 50) -> DataFrame:
        tallies = self._tables()[1]
        return recruitment.in_order(tallies if category is None else tallies.where(F.col("category") == category), by, limit)

    def recruiter(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(the recruiter's tally, its recruits by TPE)."""
        edges, tallies = self._tables()
        mine = recruitment.addressable(edges, name).select("user_id", "username", "career_tpe")
        return recruitment.addressable(tallies, name), mine.orderBy(F.col("career_tpe").desc(), F.lower("username"), "user_id")

    def lineage(self, name: str, depth: int = recruitment.MOST_DEPTH) -> DataFrame:
        return recruitment.tree(self._tables()[0], name, depth)


class Boards:
    """Reads of scouting boards; changes are the pure functions of ``operators.ranklist``."""

    def __init__(self, tables: Dataset):
        self.tables = tables

    def teams_of(self, user_id: str) -> DataFrame:
        """Teams of a member with role, members and boards counted."""
        t = self.tables
        mine = t.members.where(F.col("user_id") == user_id).select("team_id", "role")
        rows = ranklist.counts(ranklist.counts(t.scouting_teams, t.members, "team_id", "n_members"), t.boards, "team_id", "n_boards")
        return ranklist.capabilities(rows.join(mine, "team_id"))

    def entries(self, board_id: str) -> DataFrame:
        """A board's entries by rank, each with the number of its comments."""
        here = self.tables.entries.where(F.col("board_id") == board_id)
        comments = self.tables.comments.where(F.col("entry_id").isNotNull())
        return ranklist.counts(here, comments, "entry_id", "n_comments").orderBy(F.col("rank") == 0, "rank", "player_id")


@dataclass
class Rink:
    """All queries over one folder of tables."""

    spark: SparkSession
    path: str
    tables: Dataset = field(init=False)

    def __post_init__(self):
        self.tables = Dataset(self.spark, self.path)
        self.players, self.users, self.leagues = Players(self.tables), Users(self.tables), Leagues(self.tables)
        self.recruitment, self.boards = Recruitment(self.tables), Boards(self.tables)

    def meta(self) -> DataFrame:
        """(last_updated, next_update) of the last finished update."""
        return self.tables.updates.agg(F.max("finished_at").alias("last_updated")).withColumn("next_update", F.col("last_updated") + F.expr("interval 6 hours"))
