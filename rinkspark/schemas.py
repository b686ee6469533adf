"""Table schemas and literal dimensions of the league data model."""

from __future__ import annotations

# table schemas as DDL, for ``spark.read.schema`` and ``createDataFrame``
LEAGUES = "league_id int, name string, abbreviation string"
SEASONS = "league_id int, season int"
CONFERENCES = "conference_id int, league_id int, season int, name string"
DIVISIONS = "division_id int, season int, league_id int, conference_id int, name string"
TEAMS = (
    "team_id int, season int, league_id int, abbreviation string, name string, location string, "
    "colors struct<primary:string,secondary:string,text:string>, name_details struct<first:string,second:string>, "
    "stats struct<wins:int,losses:int,overtime_losses:int,shootout_wins:int,shootout_losses:int,points:int,goals_for:int,goals_against:int,win_percent:float>, "
    "division_id int, conference_id int"
)
GAMES = "slug string, game_id int, season int, league_id int, sim_date date, home_team_id int, away_team_id int, home_score int, away_score int, played boolean, overtime boolean, shootout boolean, game_type int"
USERS = "user_id int, name string, discord_id string"
PLAYERS = (
    "player_id int, user_id int, username string, creation_time timestamp, retirement_time timestamp, status int, name string, position int, handedness int, "
    "recruiter string, render string, jersey_number int, height struct<feet:int,inches:int>, weight int, birthplace string, iihf_nation string, "
    "draft_season int, current_league int, current_team_id int, shl_rights_team_id int, total_tpe int, applied_tpe int, banked_tpe int, bank_balance int, task_status string, "
    "inactive boolean, is_suspended boolean"
)
INDEX_RECORDS = "player_id int, league_id int, start_season int, user_id int, index_id int"
TPE_EVENTS = "player_id int, task_date timestamp, total_tpe int"
EARNED_TPE = "player_id int, season int, earned_tpe int"
BACKFILLS = "player_id int, backfilled_at timestamp"
MOST_RECENT = "user_id int, player_id int"
BOARD_ENTRIES = "id string, board_id string, player_id int, rank int, status string, assigned_to string, assigned_at timestamp, created_at timestamp, updated_at timestamp"
CAPTURES = "captured_at timestamp, name string, jersey_number int, position string, handedness string, attributes map<string,int>, role_ratings map<string,int>, numbers map<string,double>, text_fields map<string,string>"

# Codes, labels and short forms that stored data and payloads carry.
LEAGUE_CODES = {
    0: ("SHL", "Simulation Hockey League"),
    1: ("SMJHL", "Simulation Major Junior Hockey League"),
    2: ("IIHF", "International Ice Hockey Federation"),
    3: ("WJC", "World Junior Championship"),
}
GAME_TYPES = {1: ("Pre-Season", "ps"), 2: ("Regular Season", "rs"), 3: ("Playoffs", "po")}
GAME_ENDINGS = {"Regulation": "", "Overtime": "OT", "Shootout": "SO"}
PLAYER_STATUS = {0: "Pending", 1: "Denied", 2: "Active", 3: "Retired"}
TASK_STATUS = ("Pending Approval", "Draftee Free Agent", "SMJHL Rookie", "SHL/Send-down", "Retired")
HANDEDNESS = {0: "Left", 1: "Right"}
POSITIONS = {0: ("G", "Goalie"), 1: ("LD", "Left Defense"), 2: ("RD", "Right Defense"), 4: ("C", "Center"), 5: ("LW", "Left Wing"), 6: ("RW", "Right Wing")}
RECRUITER_CATEGORIES = {0: "Player", 1: "External", 2: "Self", 3: "None"}
TEAM_ROLES = {0: "Viewer", 1: "Editor", 2: "Owner"}
