"""The tables' schemas, keys and relations. Nothing is inferred at load.

Encodings: side and half are 0 for the visitors and 1 for the home team (in pitching_daily and fielding_daily the
side in the field); batting_order 0 is the pitcher of a lineup with a designated hitter; fielding_position 10 to
12 are designated hitter, pinch hitter and pinch runner; destinations are 0 out or none, 1 to 3 a base, 4 scored.
"""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 1

_TYPES = {
    "text": T.StringType(), "int": T.IntegerType(), "short": T.ShortType(), "bool": T.BooleanType(), "date": T.DateType(),
}


def _ordered(columns: str) -> T.StructType:
    """``name`` is text; ``name:type`` is that type."""
    pairs = [c.partition(":") for c in columns.split()]
    return T.StructType([T.StructField(n, _TYPES[kind or "text"]) for n, _, kind in pairs])


TABLES: dict[str, T.StructType] = {
    "people": _ordered(
        "player_id last_name first_name nickname birth_date:date birth_city birth_state birth_country play_debut:date "
        "play_last_game:date mgr_debut:date mgr_last_game:date coach_debut:date coach_last_game:date ump_debut:date "
        "ump_last_game:date death_date:date death_city death_state death_country bats throws height weight:int cemetery "
        "ceme_city ceme_state ceme_country ceme_note birth_name name_chg bat_chg hof"
    ),
    "teams": _ordered("team_id league city nickname first_year:int last_year:int"),
    "ballparks": _ordered("park_id name aka city state start_date:date end_date:date league notes"),
    "coaches": _ordered("player_id year:int team role start_date:date end_date:date"),
    "ejections": _ordered(
        "game_id ejection_date:date dh ejectee_id ejectee_name team job umpire_id umpire_name inning:int reason"
    ),
    "relatives": _ordered("player_id_1 relation player_id_2"),
    "roster": _ordered("year:int team player_id last_name first_name bats throws position"),
    "schedule": _ordered(
        "game_date:date game_number:int day_of_week visitor_team visitor_league visitor_game_number:int home_team home_league "
        "home_game_number:int day_night site postponed makeup"
    ),
    "game": _ordered(
        "game_id game_date:date game_number:int game_type visitor_team home_team site start_time day_night innings:int tiebreaker "
        "use_dh:bool home_team_bats_first:bool pitches ump_home ump_1b ump_2b ump_3b ump_lf ump_rf field_cond precip sky temp:int "
        "wind_dir wind_speed:int time_of_game:int attendance:int winning_pitcher losing_pitcher save_pitcher gwrbi how_scored "
        "official_scorer scorer translator inputter input_time edit_time input_prog_vers"
    ),
    "game_info": _ordered("game_id key value"),
    "lineup_start": _ordered("game_id player_id player_name side:short batting_order:short fielding_position:short"),
    "substitution": _ordered("game_id seq:int player_id player_name side:short batting_order:short fielding_position:short"),
    "comment": _ordered("game_id seq:int text"),
    "earned_runs": _ordered("game_id player_id earned_runs:int"),
    "game_adjustment": _ordered("game_id seq:int adj_type field1 field2"),
    "play": _ordered(
        "game_id play_seq:int inning:int half:short batter_id pitcher_id outs_before:short balls:short strikes:short pitch_seq event "
        "event_code:short event_name hit_value:short at_bat:bool sac_fly:bool sac_hit:bool double_play:bool triple_play:bool "
        "wild_pitch:bool passed_ball:bool outs_on_play:short rbi:short runs_on_play:short away_score_before:short "
        "home_score_before:short base1_before base2_before base3_before batter_dest:short run1_dest:short run2_dest:short run3_dest:short"
    ),
    "batting_daily": _ordered(
        "game_id player_id team game_date:date side:short plate_appearances:int at_bats:int runs:int hits:int doubles:int triples:int "
        "home_runs:int rbi:int walks:int intentional_walks:int strikeouts:int hit_by_pitch:int sac_hits:int sac_flies:int gidp:int "
        "stolen_bases:int caught_stealing:int total_bases:int"
    ),
    "pitching_daily": _ordered(
        "game_id player_id team game_date:date side:short games_started:bool outs:int batters_faced:int hits:int home_runs:int runs:int "
        "earned_runs:int walks:int intentional_walks:int strikeouts:int hit_by_pitch:int wild_pitches:int balks:int won:bool lost:bool saved:bool"
    ),
    "fielding_daily": _ordered(
        "game_id player_id team game_date:date position:short side:short games:short games_started:bool outs:int po:int a:int e:int "
        "dp:int tp:int pb:int xi:int"
    ),
    "game_log": _ordered(
        "game_id game_date:date game_number:short visitor_team home_team visitor_score:short home_score:short park_id attendance:int "
        "time_of_game_min:int visitor_manager_id visitor_manager_name home_manager_id home_manager_name winning_pitcher_id "
        "losing_pitcher_id save_pitcher_id visitor_starter_id home_starter_id"
    ),
}

PLAY = TABLES["play"]
FIELDING_LINE = T.StructType([f for f in TABLES["fielding_daily"].fields if f.name not in ("team", "game_date")])

#: Unique columns of the tables that have any.
KEYS = {
    "people": ("player_id",), "teams": ("team_id",), "ballparks": ("park_id",), "game": ("game_id",), "game_log": ("game_id",),
    "play": ("game_id", "play_seq"), "batting_daily": ("game_id", "player_id"), "pitching_daily": ("game_id", "player_id"),
    "fielding_daily": ("game_id", "player_id", "position"),
}

#: Relations: a child's column to the parent's key.
RELATIONS = {("coaches", "player_id"): ("people", "player_id")} | {
    (child, "game_id"): ("game", "game_id")
    for child in (
        "game_info", "lineup_start", "substitution", "comment", "earned_runs", "game_adjustment", "play", "batting_daily",
        "pitching_daily", "fielding_daily",
    )
}

#: Columns that ``condition`` and ``order_by`` of a connection take: keys, relations, and what lookups are made by.
LOOKUPS = ("player_id", "team", "team_id", "park_id", "game_id", "game_date", "year", "season", "home_team", "visitor_team", "site", "last_name", "position", "batter_id", "pitcher_id", "event_code")
