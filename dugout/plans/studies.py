"""Studies over the tables: leads given away, first sightings, a pitcher's workload, and run support.

Every study is a function from a mapping of tables (such as ``Store.tables()``) and its parameters to one DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.columns import count_if, decade, rate, regular_season, standard_error, sum_if, welch_t
from dugout.functions.events import completes_turn, derived_runs
from dugout.operators.relational import first_per_key, unpivot, with_total
from dugout.operators.shared import written

Tables = Mapping[str, DataFrame]

# --- leads ------------------------------------------------------------------


def score_path(play: DataFrame) -> DataFrame:
    """After every play: both scores by derived runs, each side's lead and its greatest lead so far. One sort by game."""
    w = Window.partitionBy("game_id").orderBy("play_seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = derived_runs(F.col("event"))
    scored = play.select("game_id", "play_seq", "inning", F.when(F.col("half") == 0, runs).otherwise(0).alias("v"), F.when(F.col("half") == 1, runs).otherwise(0).alias("h"))
    running = scored.select("game_id", "play_seq", "inning", F.sum("v").over(w).alias("vis"), F.sum("h").over(w).alias("home"))
    running = running.withColumn("ahead", F.col("vis") - F.col("home"))
    return running.withColumns({"peak_vis_lead": F.max("ahead").over(w), "peak_home_lead": F.max(-F.col("ahead")).over(w)})


def _gone(threshold: int, side: str):
    lead = F.col("ahead") if side == "vis" else -F.col("ahead")
    return (F.col(f"peak_{side}_lead") >= threshold) & (lead <= 0)


def high_scoring(t: Tables, least: int) -> DataFrame:
    """Games whose sides both ended on at least so many runs: whoever gave away a lead of that size is among them."""
    return t["game_log"].filter((F.col("visitor_score") >= least) & (F.col("home_score") >= least))


def _given_away(t: Tables, threshold: int) -> DataFrame:
    candidates = high_scoring(t, threshold).select("game_id")
    path = score_path(t["play"].join(candidates, "game_id", "left_semi"))
    lead = F.abs("ahead")
    place = lambda *c: F.struct("inning", F.col("vis").alias("v"), F.col("home").alias("h"))
    gone = _gone(threshold, "vis") | _gone(threshold, "home")
    by_game = path.groupBy("game_id").agg(
        F.max(_gone(threshold, "vis")).alias("vis_blew"), F.max(_gone(threshold, "home")).alias("home_blew"), F.max(lead).alias("lead"),
        F.max_by(place(), F.struct(lead, -F.col("play_seq"))).alias("at_peak"), F.min_by(place(), F.when(gone, F.col("play_seq"))).alias("at_level"),
        F.max("vis").alias("derived_vis"), F.max("home").alias("derived_home"), F.max("inning").alias("innings"),
    )
    scores = t["game_log"].select("game_id", "visitor_score", "home_score")
    same = (F.col("derived_vis") == F.col("visitor_score")) & (F.col("derived_home") == F.col("home_score"))
    return by_game.filter(F.col("vis_blew") | F.col("home_blew")).join(scores, "game_id").withColumn("score_verified", same)


def blown_leads(t: Tables, threshold: int = 11) -> DataFrame:
    """Games in which a lead of ``threshold`` runs was wholly given up: where it peaked, where it was gone, how it ended."""
    teams = t["teams"].select("team_id", F.concat_ws(" ", "city", "nickname").alias("name"))
    named = lambda side: teams.select(F.col("team_id").alias(f"{side}_team"), F.col("name").alias(f"{side}_name"))
    game = t["game"].select("game_id", "game_date", "visitor_team", "home_team", "attendance")
    rows = _given_away(t, threshold).join(game, "game_id").join(named("visitor"), "visitor_team", "left").join(named("home"), "home_team", "left")
    return rows.select(
        "game_id", "game_date", "visitor_team", "home_team", "visitor_name", "home_name", "vis_blew", "home_blew", "lead",
        F.col("at_peak.inning").alias("peak_inning"), F.col("at_peak.v").alias("peak_vis"), F.col("at_peak.h").alias("peak_home"),
        F.col("at_level.inning").alias("tie_inning"), F.col("at_level.v").alias("tie_vis"), F.col("at_level.h").alias("tie_home"),
        "visitor_score", "home_score", "innings", "attendance", "score_verified",
    )


def near_misses(t: Tables, threshold: int = 11) -> DataFrame:
    """Games in which a lead one run short of the threshold was given up, and none that reached it."""
    below = _given_away(t, threshold - 1).join(_given_away(t, threshold).select("game_id"), "game_id", "left_anti")
    game = t["game"].select("game_id", "game_date", "visitor_team", "home_team")
    return below.join(game, "game_id").select("game_id", "game_date", "visitor_team", "home_team", "vis_blew", "home_blew", "lead", "visitor_score", "home_score", "score_verified")


def lead_population(t: Tables, thresholds: Sequence[int] = (10, 11)) -> DataFrame:
    """Games, and those in which a side ever led by so many: over all plays, as a lead that held has no prefilter."""
    leads = score_path(t["play"]).groupBy("game_id").agg(F.max(F.abs("ahead")).alias("lead"))
    return leads.agg(F.count("*").alias("games"), *[count_if(F.col("lead") >= n).alias(f"led_by_{n}") for n in thresholds])


def run_derivation_check(t: Tables) -> DataFrame:
    """Games whose stored runs, and whose derived runs, agree with the official final."""
    of = lambda value, half: sum_if(F.col("half") == half, value)
    runs = t["play"].select("game_id", "half", F.col("runs_on_play").alias("stored"), derived_runs(F.col("event")).alias("derived"))
    by_game = runs.groupBy("game_id").agg(*[of(v, h).alias(f"{v}{h}") for v in ("stored", "derived") for h in (0, 1)])
    agree = lambda v: count_if((F.col(f"{v}0") == F.col("visitor_score")) & (F.col(f"{v}1") == F.col("home_score"))).alias(f"{v}_match")
    return by_game.join(t["game_log"], "game_id").agg(F.count("*").alias("games"), agree("stored"), agree("derived"))


def _plays_and_games(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("plays"), F.countDistinct("game_id").alias("games"))


def phantom_run_plays(t: Tables) -> DataFrame:
    """Force outs with a run but without any advance."""
    return _plays_and_games(t["play"].filter((F.col("runs_on_play") > 0) & F.col("event").contains("/FO") & ~F.col("event").contains(".")))


def dropped_run_plays(t: Tables) -> DataFrame:
    """Plays with more advances to home than runs; home runs and steals of home aside."""
    event = F.col("event")
    return _plays_and_games(t["play"].filter(~event.contains("HR") & ~event.contains("SBH") & (F.regexp_count(event, F.lit("-H")) > F.col("runs_on_play"))))


def _covered(t: Tables, least: int) -> DataFrame:
    there = t["game"].select("game_id", F.lit(True).alias("_there"))
    return high_scoring(t, least).join(there, "game_id", "left").select("game_date", F.col("_there").isNull().alias("gap"))


def coverage(t: Tables, least: int = 11) -> DataFrame:
    """High-scoring games, and those of them without plays."""
    date = F.when(F.col("gap"), F.col("game_date"))
    return _covered(t, least).agg(
        F.count("*").alias("candidates"), count_if(F.col("gap")).alias("without_plays"), F.min(date).alias("earliest_gap"), F.max(date).alias("latest_gap")
    )


def coverage_by_decade(t: Tables, least: int = 11) -> DataFrame:
    rows = _covered(t, least).groupBy(decade("game_date").alias("decade")).agg(F.count("*").alias("candidates"), count_if(F.col("gap")).alias("without_plays"))
    return rows.filter("without_plays > 0")


# --- sightings --------------------------------------------------------------


def bad_links(t: Tables, links: DataFrame) -> DataFrame:
    """Links (game_id, logged_date) that name no game, or one of another date."""
    dates = t["game"].select("game_id", F.col("game_date").alias("points_to"))
    return links.join(dates, "game_id", "left").filter(F.col("points_to").isNull() | (F.col("points_to") != F.col("logged_date"))).select("game_id", "logged_date", "points_to")


def _first_seen(t: Tables, links: DataFrame, seen: DataFrame) -> DataFrame:
    good = links.join(t["game"].select("game_id", "game_date", "visitor_team", "home_team"), "game_id").filter("game_date = logged_date")
    people = t["people"].filter("hof = 'HOF'").select("player_id", "last_name", F.concat_ws(" ", F.coalesce(F.nullif("nickname", F.lit("")), "first_name"), "last_name").alias("name"))
    rows = seen.join(good, "game_id").join(people, "player_id")
    return first_per_key(rows, ["player_id"], ["game_date", "game_id"]).select("player_id", "name", "last_name", F.col("game_date").alias("first_seen"), "visitor_team", "home_team")


def first_sightings(t: Tables, links: DataFrame) -> DataFrame:
    """The first of the linked games in which each honoured player took the field."""
    return _first_seen(t, links, t["lineup_start"].select("game_id", "player_id").unionByName(t["substitution"].select("game_id", "player_id")))


def first_managers(t: Tables, links: DataFrame) -> DataFrame:
    """The first of the linked games in which each honoured person managed."""
    sides = {side: [F.col(f"{side}_manager_id")] for side in ("visitor", "home")}
    return _first_seen(t, links, unpivot(t["game_log"], ["game_id"], sides, ["player_id"]).drop("role"))


def by_induction(rows: DataFrame, years: Mapping[str, int]) -> DataFrame:
    """Sightings with ``inducted``, the year that a person was honoured by the look-up relation ``years``, in that order: the
    oldest class first, those without a year last, by name within a class (in binary order)."""
    known = rows.sparkSession.createDataFrame(list(years.items()), "player_id string, inducted int")
    return rows.join(known, "player_id", "left").orderBy(F.asc_nulls_last("inducted"), "name", "player_id")


# --- a pitcher's workload ----------------------------------------------------


def regular(t: Tables, table: str) -> DataFrame:
    """A table's rows of regular-season games."""
    return t[table].join(t["game"].filter(regular_season("game_type")).select("game_id"), "game_id", "left_semi")


def season_lines(t: Tables, season: int) -> Tables:
    """The tables with the pitching lines of one season, written: a study that reads them several times makes them once."""
    return {**t, "pitching_daily": written(t["pitching_daily"].filter(F.year("game_date") == season), "lines")}


def _pitched(t: Tables, pitcher: str) -> DataFrame:
    return regular(t, "pitching_daily").filter(F.col("player_id") == pitcher).withColumn("season", F.year("game_date"))


def workload_by_season(t: Tables, pitcher: str, least_starts: int = 10) -> DataFrame:
    """Starts, batters and innings a start, decisions and earned-run average, of seasons with enough starts."""
    started = F.col("games_started")
    sums = _pitched(t, pitcher).groupBy("season").agg(
        count_if(started).alias("gs"), sum_if(started, "batters_faced").alias("bf_in_starts"), sum_if(started, "outs").alias("o"),
        count_if(F.col("won")).alias("w"), count_if(F.col("lost")).alias("l"), F.sum("earned_runs").alias("er"), F.sum("outs").alias("outs"),
    ).filter(F.col("gs") >= least_starts)
    return sums.select(
        "season", "gs", "bf_in_starts", rate("bf_in_starts", "gs", 2).alias("bf_per_start"), rate("o", F.col("gs") * 3, 2).alias("ip_per_start"),
        "w", "l", rate("er", "outs", 2, 27).alias("era"),
    )


def workload_when_effective(t: Tables, pitcher: str, most_runs: int = 2, whole_game: int = 27, least_starts: int = 10) -> DataFrame:
    """The same of starts with few runs, and how many of them ended before the order's third time through."""
    good, early = F.col("runs") <= most_runs, (F.col("runs") <= most_runs) & (F.col("batters_faced") < whole_game)
    sums = _pitched(t, pitcher).filter("games_started").groupBy("season").agg(
        F.count("*").alias("gs"), F.sum("batters_faced").alias("bf"), count_if(good).alias("starts_good"), sum_if(good, "batters_faced").alias("bf_good"),
        sum_if(good, "outs").alias("o_good"), count_if(early).alias("pulled_early"),
    ).filter(F.col("gs") >= least_starts)
    return sums.select(
        "season", "gs", rate("bf", "gs", 2).alias("bf_per_start"), "starts_good", rate("bf_good", "starts_good", 2).alias("bf_per_good_start"),
        rate("o_good", F.col("starts_good") * 3, 2).alias("ip_per_good_start"), "pulled_early", rate("pulled_early", "starts_good", 1, 100).alias("pct_pulled_early"),
    )


def times_through_split(t: Tables, pitcher: str, batters: int = 18, least_starts: int = 10) -> DataFrame:
    """Outs, runs and scaled earned-run average of a pitcher's starts before and after so many batters.

    The batter's number is a running sum of completed turns; plays within a turn count to it.
    """
    starts = _pitched(t, pitcher).filter("games_started").select("game_id", "season")
    done = completes_turn(F.col("event_code"))
    w = Window.partitionBy("game_id").orderBy("play_seq").rowsBetween(Window.unboundedPreceding, 0)
    plays = t["play"].filter(F.col("pitcher_id") == pitcher).join(starts, "game_id")
    number = F.sum(done.cast("int")).over(w) + F.when(done, 0).otherwise(1)
    plays = plays.select("season", "game_id", "outs_on_play", "runs_on_play", number.alias("number"))
    first = F.col("number") <= batters
    sums = plays.groupBy("season").agg(
        F.countDistinct("game_id").alias("gs"), sum_if(first, "outs_on_play").alias("o1"), sum_if(first, "runs_on_play").alias("r1"),
        F.sum("outs_on_play").alias("o"), F.sum("runs_on_play").alias("r"),
    ).filter(F.col("gs") >= least_starts)
    charged = t["pitching_daily"].filter(F.col("player_id") == pitcher).groupBy(F.year("game_date").alias("season")).agg(F.sum("earned_runs").alias("er"), F.sum("runs").alias("ra"))
    rows = sums.join(charged, "season").withColumns({"o2": F.col("o") - F.col("o1"), "r2": F.col("r") - F.col("r1")})
    era = lambda r, o: rate(F.col(r) * F.col("er"), F.col(o) * F.col("ra"), 2, 27)
    return rows.select(
        "season", "gs", rate("o1", F.lit(3), 1).alias("ip_first"), F.col("r1").alias("runs_first"), era("r1", "o1").alias("era_first"),
        rate("o2", F.lit(3), 1).alias("ip_after"), F.col("r2").alias("runs_after"), era("r2", "o2").alias("era_after"),
        era("r", "o").alias("era_full"), rate("o2", "o", 1, 100).alias("pct_ip_after"),
    )


# --- run support ------------------------------------------------------------


def team_runs(t: Tables, season: int | None = None, teams: Sequence[str] | None = None) -> DataFrame:
    """Runs of a team in each regular-season game: game_id, team, season, runs."""
    rows = regular(t, "batting_daily").withColumn("season", F.year("game_date"))
    rows = rows if season is None else rows.filter(F.col("season") == season)
    rows = rows if teams is None else rows.filter(F.col("team").isin(list(teams)))
    return rows.groupBy("game_id", "team", "season").agg(F.sum("runs").alias("runs"))


def support(t: Tables, team: str, pitcher: str, season: int) -> DataFrame:
    """A team's games of a season: runs, venue (home or road), and if the pitcher started."""
    own = _pitched(t, pitcher).filter("games_started").select("game_id", F.lit(True).alias("_own"))
    home = t["game"].select("game_id", F.when(F.col("home_team") == team, "home").otherwise("road").alias("venue"))
    rows = team_runs(t, season, [team]).join(home, "game_id").join(own, "game_id", "left")
    return rows.select("game_id", "season", "runs", "venue", F.coalesce("_own", F.lit(False)).alias("own_start"))


def support_test(t: Tables, team: str, pitcher: str, season: int) -> DataFrame:
    """Run support in the pitcher's starts against the team's other games, by venue and over all, with Welch's t."""
    own, runs = F.col("own_start"), F.col("runs").cast("double")
    mean = lambda c: F.round(F.avg(F.when(c, runs)).cast("decimal(20,8)"), 2)
    share = lambda c: F.round((100 * F.avg(F.when(c, (runs <= 1).cast("int")))).cast("decimal(20,8)"), 1)
    return with_total(support(t, team, pitcher, season), "venue", [
        count_if(own).alias("starts"), mean(own).alias("support"), count_if(~own).alias("other_games"), mean(~own).alias("other_support"),
        F.round(welch_t(own, runs).cast("decimal(20,8)"), 2).alias("t_stat"), share(own).alias("pct_starts_le1"), share(~own).alias("pct_others_le1"),
    ])


def run_support(t: Tables, team: str, pitcher: str, season: int) -> DataFrame:
    """A team's runs a game in the pitcher's starts and in its other games, by venue and over all: one pass for both."""
    own, runs = F.col("own_start"), F.col("runs").cast("double")
    mean = lambda c: F.round(F.avg(F.when(c, runs)).cast("decimal(20,8)"), 2)
    return with_total(support(t, team, pitcher, season), "venue", [
        count_if(own).alias("own_starts"), mean(own).alias("runs_own_starts"), count_if(~own).alias("other_games"), mean(~own).alias("runs_other_games"),
    ])


def runs_by_park(t: Tables, season: int) -> DataFrame:
    """Runs of both sides a game, by host; games with one side only are left out."""
    home = t["game"].select("game_id", F.col("home_team").alias("host"))
    games = team_runs(t, season).join(home, "game_id").groupBy("game_id", "host").agg(F.sum("runs").alias("runs"), F.count("*").alias("sides"))
    return games.filter("sides = 2").groupBy("host").agg(F.count("*").alias("games"), rate(F.sum("runs"), F.count("*"), 2).alias("runs_per_game"))


def support_by_starter(t: Tables, team: str, season: int, least_starts: int = 5, least_outs: int = 150) -> DataFrame:
    """Run support of each of a team's starters, its deviation and standard error, and how good their opponents were."""
    t = season_lines(t, season)
    starters = regular(t, "pitching_daily").filter(F.col("games_started"))
    mine = starters.filter(F.col("team") == team).select("game_id", "player_id")
    against = starters.filter(F.col("team") != team).select("game_id", F.col("player_id").alias("opponent"))
    year = t["pitching_daily"].groupBy(F.col("player_id").alias("opponent")).agg(F.sum("outs").alias("o"), F.sum("earned_runs").alias("er"))
    quality = mine.join(against, "game_id").join(year.filter(F.col("o") >= least_outs), "opponent").groupBy("player_id").agg(F.avg(F.col("er") * 27 / F.col("o")).alias("opposing_era"))
    rounded = lambda c: F.round(c.cast("decimal(20,8)"), 2)
    rows = mine.join(team_runs(t, season, [team]), "game_id").groupBy("player_id").agg(
        F.count("*").alias("gs"), rounded(F.avg("runs")).alias("support"), rounded(F.stddev_samp("runs")).alias("sd"), rounded(standard_error("runs")).alias("se"),
        rate(count_if(F.col("runs") <= 2), F.count("*"), 1, 100).alias("pct_starts_le2"),
    ).filter(F.col("gs") >= least_starts)
    return rows.join(quality.withColumn("opposing_era", rounded(F.col("opposing_era"))), "player_id", "left")


def offense_in_context(t: Tables, team: str, league: Sequence[str], seasons: Sequence[int]) -> DataFrame:
    """A team's runs a game by season, its rank in the league, and the league's average."""
    by_team = team_runs(t, teams=league).filter(F.col("season").isin(list(seasons))).groupBy("season", "team").agg(F.sum("runs").alias("r"), F.count("*").alias("g"))
    ranked = by_team.withColumn("rank", F.rank().over(Window.partitionBy("season").orderBy(F.desc(F.col("r") / F.col("g")))))
    own = F.col("team") == team
    return ranked.groupBy("season").agg(
        rate(sum_if(own, "r"), sum_if(own, "g"), 2).alias("runs_per_game"), F.max(F.when(own, F.col("rank"))).alias("league_rank"),
        rate(F.sum("r"), F.sum("g"), 2).alias("league_average"),
    )
