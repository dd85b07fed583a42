"""Studies of a starter: what follows his exit, his game log, and what his side does behind him.

As in ``studies``, each is a function from a mapping of tables and its parameters to one DataFrame. Averages are over
the rows that have a value; a share of no rows is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.columns import count_if, rate, regular_season, sum_if, welch_t
from dugout.operators.relational import unpivot
from dugout.operators.shared import written
from dugout.plans.studies import Tables, regular, season_lines

_BASES = ("base1_before", "run1_dest"), ("base2_before", "run2_dest"), ("base3_before", "run3_dest")


def _rounded(c: Column, digits: int = 2) -> Column:
    return F.round(c.cast("decimal(20,8)"), digits)


def _in_season(season: int) -> Column:
    return F.year("game_date") == season


def _starts(t: Tables, pitcher: str, season: int) -> DataFrame:
    """All games that the pitcher started in a season: game_id."""
    return t["pitching_daily"].filter((F.col("player_id") == pitcher) & F.col("games_started") & _in_season(season)).select("game_id").distinct()


def _own_starts(t: Tables, pitcher: str, season: int) -> DataFrame:
    """His lines of regular-season starts."""
    return regular(t, "pitching_daily").filter((F.col("player_id") == pitcher) & F.col("games_started") & _in_season(season))


def bullpen_split(t: Tables, league: Sequence[str], team: str, pitcher: str, season: int) -> DataFrame:
    """Relief innings and runs a nine innings: the league, the team, and the team in and outside the pitcher's starts.

    One scan; a group without innings has nulls.
    """
    t = season_lines(t, season)
    lines = regular(t, "pitching_daily").filter(F.col("team").isin(list(league)) & ~F.col("games_started") & _in_season(season))
    lines = lines.join(_starts(t, pitcher, season).withColumn("_own", F.lit(True)), "game_id", "left")
    ours, behind = F.col("team") == team, F.col("_own").isNotNull()
    groups = {"league": F.lit(True), "team": ours, "team, his starts": ours & behind, "team, other starts": ours & ~behind}
    sums = lines.agg(*[sum_if(c, v).alias(f"{v} {name}") for name, c in groups.items() for v in ("outs", "runs")])
    rows = unpivot(sums, [], {name: [F.col(f"`outs {name}`"), F.col(f"`runs {name}`")] for name in groups}, ["outs", "runs"])
    return rows.select(F.col("role").alias("relievers"), rate("outs", F.lit(3), 1).alias("ip"), F.col("runs").alias("runs_allowed"), rate("runs", "outs", 2, 27).alias("ra9"))


def bequeathed_runners(t: Tables, pitcher: str, season: int) -> DataFrame:
    """For each start: runners left on base at the pitcher's last play, and those of them who scored later in that
    half-inning, followed by their ids."""
    starts = _own_starts(t, pitcher, season).select("game_id", "game_date", "batters_faced", "outs", "runs", "earned_runs")
    whole_game = Window.partitionBy("game_id")
    mine = F.col("pitcher_id") == pitcher
    plays = t["play"].join(starts.select("game_id"), "game_id", "left_semi").withColumn("_last", F.max(F.when(mine, F.col("play_seq"))).over(whole_game))
    during = plays.filter(mine).groupBy("game_id").agg(F.sum("runs_on_play").alias("runs_during"))
    movers = {who: [F.col(who), F.col(dest)] for who, dest in _BASES}
    ends = unpivot(plays.filter("play_seq >= _last"), ["game_id", "inning", "half", "play_seq", "_last"], movers | {"batter": [F.col("batter_id"), F.col("batter_dest")]}, ["runner", "dest"])
    # one sum by runner in place of a join: of both plays and their later fate the partitions by game will do
    left, home = F.expr("play_seq = _last AND dest BETWEEN 1 AND 3"), F.expr("play_seq > _last AND role <> 'batter' AND dest >= 4")
    by_runner = ends.filter("runner <> ''").groupBy("game_id", "inning", "half", "runner").agg(count_if(left).alias("left"), count_if(home).alias("home"))
    after = by_runner.groupBy("game_id").agg(F.sum("left").alias("left_on"), F.sum(F.col("left") * F.col("home")).alias("scored"))
    rows = starts.join(during, "game_id").join(after, "game_id", "left")
    return rows.select(
        "game_id", "game_date", F.col("batters_faced").alias("bf"), rate("outs", F.lit(3), 1).alias("ip"), "runs_during",
        F.coalesce("left_on", F.lit(0)).alias("runners_left_on"), F.coalesce("scored", F.lit(0)).alias("bequeathed_scored"),
        F.col("runs").alias("charged_r"), F.col("earned_runs").alias("charged_er"),
    )


def lead_holding(t: Tables, league: Sequence[str], team: str, pitcher: str, season: int) -> DataFrame:
    """Leads and ties at the exit of every starter of a league, and how they ended: the pitcher, his team's other
    starters, all others.

    The score at the exit is that before the next play, or the final one: a look-ahead on one sort by game.
    """
    starts = regular(t, "pitching_daily").filter(F.col("games_started") & F.col("team").isin(list(league)) & _in_season(season)).select("game_id", "player_id", "team")
    plays = t["play"].join(starts.select("game_id"), "game_id", "left_semi")
    game, order = Window.partitionBy("game_id"), Window.partitionBy("game_id").orderBy("play_seq")
    after = {"away": F.col("away_score_before") + F.when(F.col("half") == 0, F.col("runs_on_play")).otherwise(0), "home": F.col("home_score_before") + F.when(F.col("half") == 1, F.col("runs_on_play")).otherwise(0)}
    scores = plays.select("game_id", "play_seq", "pitcher_id", *[F.lead(f"{s}_score_before").over(order).alias(f"{s}_next") for s in after], *[F.max(c).over(game).alias(f"{s}_final") for s, c in after.items()])
    exits = scores.groupBy("game_id", F.col("pitcher_id").alias("player_id"), "away_final", "home_final").agg(
        F.max_by(F.struct(F.coalesce("away_next", "away_final").alias("away"), F.coalesce("home_next", "home_final").alias("home")), "play_seq").alias("at_exit")
    )
    rows = starts.join(exits, ["game_id", "player_id"]).join(t["game"].select("game_id", "home_team"), "game_id")
    at_home = F.col("team") == F.col("home_team")
    margin = lambda home, away: F.when(at_home, F.col(home) - F.col(away)).otherwise(F.col(away) - F.col(home))
    group = F.when(F.col("player_id") == pitcher, "pitcher").when(F.col("team") == team, "team").otherwise("league")
    rows = rows.select(group.alias("starters"), margin("at_exit.home", "at_exit.away").alias("exit"), margin("home_final", "away_final").alias("final"))
    ahead, level, won = F.col("exit") > 0, F.col("exit") == 0, F.col("final") > 0
    return rows.groupBy("starters").agg(
        count_if(ahead).alias("exits_with_lead"), count_if(ahead & won).alias("leads_held"), rate(count_if(ahead & won), count_if(ahead), 1, 100).alias("pct_leads_held"),
        count_if(level).alias("exits_tied"), rate(count_if(level & won), count_if(level), 1, 100).alias("pct_tied_won"),
    )


def start_log(t: Tables, pitcher: str, season: int) -> DataFrame:
    """A line for each start: opponent, what he did, and what his team's other pitchers did in that game."""
    t = season_lines(t, season)
    starts = _own_starts(t, pitcher, season).select("game_id", "game_date", "team", "outs", "batters_faced", "runs", "earned_runs", "strikeouts", "walks", "won", "lost")
    others = t["pitching_daily"].filter(F.col("player_id") != pitcher).groupBy("game_id", "team").agg(F.sum("outs").alias("pen_outs"), F.sum("runs").alias("pen_runs"))
    game = t["game"].select("game_id", "home_team", "visitor_team")
    rows = starts.join(game, "game_id").join(others, ["game_id", "team"], "left")
    at_home = F.col("home_team") == F.col("team")
    return rows.select(
        "game_id", "game_date", F.when(at_home, F.concat(F.lit("vs "), "visitor_team")).otherwise(F.concat(F.lit("at "), "home_team")).alias("opponent"),
        F.col("batters_faced").alias("bf"), rate("outs", F.lit(3), 1).alias("ip"), F.col("runs").alias("r"), F.col("earned_runs").alias("er"),
        F.col("strikeouts").alias("so"), F.col("walks").alias("bb"), rate(F.coalesce("pen_outs", F.lit(0)), F.lit(3), 1).alias("pen_ip"),
        F.coalesce("pen_runs", F.lit(0)).alias("pen_runs"), F.when(F.col("won"), "W").when(F.col("lost"), "L").otherwise("-").alias("decision"),
    )


def support_by_decision(t: Tables, pitcher: str, season: int, few: int = 2) -> DataFrame:
    """Innings, runs allowed and runs of his own side by the pitcher's decision."""
    runs = t["batting_daily"].groupBy("game_id", "team").agg(F.sum("runs").alias("_scored"))
    rows = _own_starts(t, pitcher, season).select("game_id", "team", "runs", "outs", "won", "lost").join(runs, ["game_id", "team"])
    decision = F.when(F.col("won"), "Win").when(F.col("lost"), "Loss").otherwise("No decision")
    n = F.count("*")
    return rows.groupBy(decision.alias("decision")).agg(
        n.alias("games"), rate(F.sum("outs"), n * 3, 2).alias("avg_ip"), rate(F.sum("runs"), n, 2).alias("avg_runs_allowed"),
        rate(F.sum("_scored"), n, 2).alias("avg_runs_scored"), count_if(F.col("runs") <= few).alias("games_allowed_few"), count_if(F.col("_scored") <= few).alias("games_scored_few"),
    )


# --- behind him against behind the others -------------------------------------


def team_games(t: Tables, team: str, pitcher: str, season: int) -> DataFrame:
    """A team's regular-season games: game_id, side, at_home, own_start (the pitcher's)."""
    theirs = (F.col("home_team") == team) | (F.col("visitor_team") == team)
    games = t["game"].filter(theirs & regular_season("game_type") & _in_season(season))
    at_home = F.col("home_team") == team
    games = games.select("game_id", at_home.alias("at_home"), at_home.cast("short").alias("side"))
    return games.join(_starts(t, pitcher, season).withColumn("_own", F.lit(True)), "game_id", "left").withColumn("own_start", F.col("_own").isNotNull()).drop("_own")


def _lineups(t: Tables, games: DataFrame) -> DataFrame:
    """The team's starting fielders but for the pitcher."""
    return t["lineup_start"].filter("fielding_position BETWEEN 2 AND 9").join(games, ["game_id", "side"]).select("game_id", "at_home", "own_start", "player_id", "fielding_position")


def _regulars(lineups: DataFrame, n: int) -> DataFrame:
    """The n players with most starts; ties go to the smaller id. At most n rows, whatever the input."""
    return lineups.groupBy("player_id").agg(F.count("*").alias("total_starts")).orderBy(F.desc("total_starts"), "player_id").limit(n)


def _opponents(t: Tables, team: str, season: int) -> DataFrame:
    return t["pitching_daily"].filter(F.col("games_started") & (F.col("team") != team) & _in_season(season)).select("game_id", F.col("player_id").alias("opponent"))


def lineup_checks(t: Tables, team: str, pitcher: str, catcher: str, season: int, regulars: int = 8, least_outs: int = 150) -> DataFrame:
    """By venue and starter: regulars in the lineup, games with the catcher, and the opposing starters' earned-run average."""
    t = season_lines(t, season)
    games = written(team_games(t, team, pitcher, season), "games")
    lineups = _lineups(t, games)
    seen = lineups.join(_regulars(lineups, regulars).withColumn("_regular", F.lit(True)), "player_id", "left")
    caught = (F.col("fielding_position") == 2) & (F.col("player_id") == catcher)
    per_game = seen.groupBy("game_id").agg(F.count("_regular").alias("_n"), count_if(caught).alias("_caught"))
    year = t["pitching_daily"].filter(_in_season(season)).groupBy(F.col("player_id").alias("opponent")).agg(F.sum("outs").alias("o"), F.sum("earned_runs").alias("er")).filter(F.col("o") >= least_outs)
    era = _opponents(t, team, season).join(year, "opponent").select("game_id", (F.col("er") * 27 / F.col("o")).alias("_era"))
    rows = games.join(per_game, "game_id", "left").join(era, "game_id", "left")
    n = F.count("*")
    return rows.groupBy(F.when(F.col("at_home"), "home").otherwise("road").alias("venue"), "own_start").agg(
        n.alias("games"), rate(F.sum("_n"), F.count("_n"), 2).alias("avg_regulars"), rate(count_if(F.col("_caught") > 0), n, 1, 100).alias("pct_catcher"), _rounded(F.avg("_era")).alias("avg_opposing_era")
    )


def regulars_rested(t: Tables, team: str, pitcher: str, season: int, regulars: int = 8) -> DataFrame:
    """For each regular, his share of starts: at home behind the pitcher, at home otherwise, on the road behind the pitcher."""
    games = written(team_games(t, team, pitcher, season), "games")  # read four times, and planned once
    lineups = _lineups(t, games)
    home, own = F.col("at_home"), F.col("own_start")
    kinds = {"own_home": home & own, "other_home": home & ~own, "own_road": ~home & own}
    total = {k: F.col(f"_all_{k}") for k in kinds}
    totals = games.agg(*[count_if(c).alias(f"_all_{k}") for k, c in kinds.items()])
    started = lineups.groupBy("player_id").agg(*[count_if(c).alias(k) for k, c in kinds.items()])
    rows = _regulars(lineups, regulars).join(started, "player_id")
    people = t["people"].select("player_id", F.concat_ws(" ", "first_name", "last_name").alias("player"), "bats")
    return rows.join(people, "player_id").crossJoin(F.broadcast(totals)).select(
        "player_id", "player", "bats", "total_starts", F.col("own_home").alias("started_own_home"), (total["own_home"] - F.col("own_home")).alias("missed_own_home"),
        *[rate(k, total[k], 1, 100).alias(f"pct_{k}") for k in kinds],
    )


def _faced(t: Tables, team: str, pitcher: str, season: int) -> DataFrame:
    """The team's games with its runs and the hand of each opposing starter."""
    t = season_lines(t, season)
    runs = t["batting_daily"].filter((F.col("team") == team) & _in_season(season)).groupBy("game_id").agg(F.sum("runs").alias("runs"))
    hands = t["people"].select(F.col("player_id").alias("opponent"), "throws")
    return team_games(t, team, pitcher, season).join(runs, "game_id").join(_opponents(t, team, season), "game_id").join(hands, "opponent")


def platoon(t: Tables, team: str, pitcher: str, season: int) -> DataFrame:
    """By venue and starter: games against left-handed starters, and runs against each hand."""
    left, right, n = F.col("throws") == "L", F.col("throws") == "R", F.count("*")
    mean = lambda c: rate(sum_if(c, "runs"), count_if(c), 2)
    return _faced(t, team, pitcher, season).groupBy(F.when(F.col("at_home"), "home").otherwise("road").alias("venue"), "own_start").agg(
        n.alias("games"), count_if(left).alias("vs_left"), rate(count_if(left), n, 1, 100).alias("pct_vs_left"), mean(left).alias("runs_vs_left"), mean(right).alias("runs_vs_right")
    )


def home_gap_by_hand(t: Tables, team: str, pitcher: str, season: int) -> DataFrame:
    """At home, by the opposing starter's hand: runs behind the pitcher and behind the others, with Welch's t."""
    own, runs = F.col("own_start"), F.col("runs").cast("double")
    mean = lambda c: F.avg(F.when(c, runs))
    return _faced(t, team, pitcher, season).filter("at_home").groupBy(F.col("throws").alias("opposing_hand")).agg(
        count_if(own).alias("own_games"), _rounded(mean(own)).alias("own_support"), count_if(~own).alias("other_games"), _rounded(mean(~own)).alias("other_support"),
        _rounded(mean(own) - mean(~own)).alias("difference"), _rounded(welch_t(own, runs)).alias("t_stat"),
    )
