"""Derived plays cut by game once: what the daily lines and the studies over them plan, and odd lines."""

import re

import pytest
from pyspark.sql import functions as F

from dugout.plans import daily, derived, derived_studies

QUERIES = {**derived.QUERIES, **derived_studies.QUERIES}
SMALL = "/root/testdata/sf0.001"


def plan_of(spark, name):
    text = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def test_batting_lines_need_one_cut_by_game(spark):
    plan = plan_of(spark, "batting_daily")
    assert "FullOuter" not in plan and len(re.findall(r"Exchange hashpartitioning\(", plan)) == 1 and plan.count("Window [") == 1


def test_pitching_lines_are_cut_once_before_their_sum(spark):
    plan = plan_of(spark, "pitching_daily")
    assert not re.search(r"Exchange hashpartitioning\(game_id#\d+, pitcher_id", plan) and len(re.findall(r"Exchange hashpartitioning\(game_id#\d+, \d+\)", plan)) == 1


@pytest.mark.parametrize("name", ["player_batting", "player_game_log"])
def test_a_players_rows_are_kept_before_the_sum(spark, name):
    plan = plan_of(spark, name)
    assert "T1-b5" in plan[plan.rindex("HashAggregate(keys=[game_id") :]


def test_credits_are_given_to_counted_plays(spark):
    plan = plan_of(spark, "fielding_credits")
    assert "partial_count" in plan[plan.index("Generate") :]


SEASONAL = ("study_support_by_starter", "support_by_decision", "lineup_checks", "platoon", "support_test", "study_run_support", "study_runs_by_park", "start_log")


@pytest.mark.parametrize("name", SEASONAL)
def test_studies_of_a_season_read_its_lines(spark, name):
    """The plays come from the season's lines, and pitching lines that are read several times from a file of theirs."""
    plan = plan_of(spark, name)
    assert "lineitem.parquet" not in plan and "FullOuter" not in plan and plan.count("Window [") <= 2


def test_tables_of_seasons(spark):
    whole, some = derived.tables(spark, SMALL), derived.tables(spark, SMALL, [1996, 1998])
    games = whole["game"].filter(F.year("game_date").isin(1996, 1998)).select("game_id")
    for name in ("game", "play", "batting_daily", "pitching_daily", "lineup_start"):
        own = sorted(map(str, some[name].collect()))
        assert own and own == sorted(map(str, whole[name].join(games, "game_id", "left_semi").select(*some[name].columns).collect()))


PLAY = "game_id string, half int, event string, batter_id string, batter_dest int, event_code int, hit_value int, at_bat boolean, rbi int, sac_hit boolean, sac_fly boolean, double_play boolean"
PLAY += "".join(f", base{b}_before string, run{b}_dest int" for b in "123")


def test_odd_batting_lines(spark):
    """A runner who never bats, one whose runs come under another half, and plays without a batter on both sides."""
    at = lambda half, event, batter, dest, code, hit, on=None, to=0: ("g", half, event, batter, dest, code, hit, code > 1, hit, False, False, False, on, to, None, 0, None, 0)
    plays = [at(0, "HR", "a", 4, 23, 4), at(0, "SB2", "b", 0, 4, 0, "pinch", 2), at(0, "CS2(2E6)", "b", 0, 6, 0, "pinch", 4), at(1, "NP", None, 0, 1, 0), at(0, "NP", None, 0, 1, 0), at(None, "CS2(26)", "c", 0, 6, 0, "a", 0)]
    game = spark.createDataFrame([("g", "V", "H")], "game_id string, visitor_team string, home_team string").withColumn("game_date", F.lit("1996-05-01").cast("date"))
    lines = daily.batting_daily(spark.createDataFrame(plays, PLAY), game).collect()
    got = {(r.player_id, r.side): (r.team, r.runs, r.home_runs, r.stolen_bases, r.caught_stealing, r.total_bases) for r in lines}
    assert len(lines) == len(got) == 6
    assert got == {
        ("a", 0): ("V", 1, 1, 0, 1, 4), ("b", 0): ("V", 0, 0, 0, 0, 0), ("pinch", 0): ("V", 1, 0, 1, 0, 0), ("c", None): ("H", 0, 0, 0, 0, 0),
        (None, 0): ("V", 0, 0, 0, 0, 0), (None, 1): ("H", 0, 0, 0, 0, 0),
    }
