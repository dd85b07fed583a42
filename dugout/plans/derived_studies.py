"""The studies and player tools over derived games (``derived.tables``), each with equal SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.operators import sketches
from dugout.plans import studies, tools
from dugout.plans.derived import LEAGUE, PITCHER, SEASON, TEAM, Query, _plain, _r, _rate, _REG, _sql, _table, tables

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; its SQL is a body behind the tables' WITH clause."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: _plain(f(spark, d))
        if sql:
            SQL[f.__name__] = _sql(sql)
        return f

    return register


# --- leads ------------------------------------------------------------------

_RUNS = """CAST(len(regexp_extract_all(event, '[B123]-H')) + CASE WHEN regexp_matches(split_part(event, '.', 1), '^(HR|H)([^A-Za-z]|$)') AND NOT contains(event, 'B-H') THEN 1 ELSE 0 END
  + greatest(0, len(regexp_extract_all(event, 'SBH')) - CASE WHEN contains(event, '3-H') THEN 1 ELSE 0 END) AS BIGINT)"""
_PATH = f"""(SELECT game_id, play_seq, inning, sum(CASE WHEN half = 0 THEN r ELSE 0 END) OVER w AS vis, sum(CASE WHEN half = 1 THEN r ELSE 0 END) OVER w AS home FROM (SELECT *, {_RUNS} AS r FROM play)
  WINDOW w AS (PARTITION BY game_id ORDER BY play_seq))"""
_PEAKS = f"(SELECT *, vis - home AS ahead, max(vis - home) OVER w AS pv, max(home - vis) OVER w AS ph FROM {_PATH} WINDOW w AS (PARTITION BY game_id ORDER BY play_seq))"


def _given_away(n: int) -> str:
    gone = f"(pv >= {n} AND ahead <= 0 OR ph >= {n} AND ahead >= 0)"
    at = "struct_pack(i := inning, v := vis, h := home)"
    return f"""(SELECT *, dv = visitor_score AND dh = home_score AS score_verified FROM (SELECT game_id, bool_or(pv >= {n} AND ahead <= 0) AS vis_blew, bool_or(ph >= {n} AND ahead >= 0) AS home_blew, CAST(max(abs(ahead)) AS BIGINT) AS lead,
    arg_max({at}, struct_pack(a := abs(ahead), b := -play_seq)) AS at_peak, arg_min({at}, play_seq) FILTER (WHERE {gone}) AS at_level, max(vis) AS dv, max(home) AS dh, max(inning) AS innings, any_value(visitor_score) AS visitor_score, any_value(home_score) AS home_score
  FROM {_PEAKS} JOIN game_log USING (game_id) WHERE visitor_score >= {n} AND home_score >= {n} GROUP BY game_id) WHERE vis_blew OR home_blew)"""


LEAD = 2


@query(f"SELECT count(*) AS games, count(*) FILTER (WHERE lead >= 2) AS led_by_2, count(*) FILTER (WHERE lead >= 4) AS led_by_4 FROM (SELECT game_id, max(abs(vis - home)) AS lead FROM {_PATH} GROUP BY game_id)")
def study_lead_population(spark, d):
    return studies.lead_population(tables(spark, d), (2, 4))


@query(f"""SELECT game_id, game_date, visitor_team, home_team, concat(lower(visitor_team), ' Nine') AS visitor_name, concat(lower(home_team), ' Nine') AS home_name, vis_blew, home_blew, lead, at_peak.i AS peak_inning, CAST(at_peak.v AS BIGINT) AS peak_vis, CAST(at_peak.h AS BIGINT) AS peak_home,
  at_level.i AS tie_inning, CAST(at_level.v AS BIGINT) AS tie_vis, CAST(at_level.h AS BIGINT) AS tie_home, visitor_score, home_score, innings, attendance, score_verified FROM {_given_away(LEAD)} JOIN game USING (game_id)""")
def study_blown_leads(spark, d):
    return studies.blown_leads(tables(spark, d), LEAD)


@query(f"SELECT game_id, game_date, visitor_team, home_team, vis_blew, home_blew, lead, visitor_score, home_score, score_verified FROM {_given_away(LEAD - 1)} JOIN game USING (game_id) WHERE game_id NOT IN (SELECT game_id FROM {_given_away(LEAD)})")
def study_near_misses(spark, d):
    return studies.near_misses(tables(spark, d), LEAD)


@query(f"""SELECT count(*) AS games, count(*) FILTER (WHERE s0 = visitor_score AND s1 = home_score) AS stored_match, count(*) FILTER (WHERE d0 = visitor_score AND d1 = home_score) AS derived_match FROM (
  SELECT game_id, {", ".join(f"sum({v}) FILTER (WHERE half = {h}) AS {n}{h}" for n, v in (("s", "runs_on_play"), ("d", _RUNS)) for h in (0, 1))} FROM play GROUP BY game_id) JOIN game_log USING (game_id)""")
def study_run_derivation(spark, d):
    return studies.run_derivation_check(tables(spark, d))


@query("SELECT count(*) AS plays, count(DISTINCT game_id) AS games FROM play WHERE NOT contains(event, 'HR') AND NOT contains(event, 'SBH') AND len(regexp_extract_all(event, '-H')) > runs_on_play")
def study_dropped_runs(spark, d):
    return studies.dropped_run_plays(tables(spark, d))


@query("SELECT count(*) AS plays, count(DISTINCT game_id) AS games FROM (SELECT game_id, runs_on_play, replace(event, '/GDP', '/FO') AS event FROM play) WHERE runs_on_play > 0 AND contains(event, '/FO') AND NOT contains(event, '.')")
def study_phantom_runs(spark, d):
    t = tables(spark, d)
    return studies.phantom_run_plays(t | {"play": t["play"].withColumn("event", F.replace("event", F.lit("/GDP"), F.lit("/FO")))})


_COVERED = f"(SELECT l.game_date, g.game_id IS NULL AS gap FROM game_log l LEFT JOIN (SELECT * FROM game WHERE game_id IN {_REG}) g ON g.game_id = l.game_id WHERE visitor_score >= 3 AND home_score >= 3)"


def _without_exhibitions(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = tables(spark, d)
    return t | {"game": t["game"].filter("game_type IS NULL OR game_type = 'regular'")}


@query(f"SELECT count(*) AS candidates, count(*) FILTER (WHERE gap) AS without_plays, min(game_date) FILTER (WHERE gap) AS earliest_gap, max(game_date) FILTER (WHERE gap) AS latest_gap FROM {_COVERED}")
def study_coverage(spark, d):
    return studies.coverage(_without_exhibitions(spark, d), 3)


@query(f"SELECT CAST(floor(year(game_date) / 10) * 10 AS INT) AS decade, count(*) AS candidates, count(*) FILTER (WHERE gap) AS without_plays FROM {_COVERED} GROUP BY 1 HAVING count(*) FILTER (WHERE gap) > 0")
def study_coverage_by_decade(spark, d):
    return studies.coverage_by_decade(_without_exhibitions(spark, d), 3).withColumn("decade", F.col("decade").cast("int"))


# --- sightings --------------------------------------------------------------

_LINKS = ["CASE WHEN o_orderkey % 7 = 0 THEN concat('none', o_orderkey) ELSE concat('G', o_orderkey) END AS game_id", "CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS logged_date"]
_LINKED = f"(SELECT {', '.join(_LINKS)} FROM orders WHERE o_custkey % 3 = 0)"
_HONOURED = "(SELECT player_id, lower(player_id) AS last_name, concat(upper(player_id), ' ', lower(player_id)) AS name FROM people WHERE player_id LIKE '%-b1%')"
_SUBS = ["concat('G', l_orderkey) AS game_id", "concat('T', l_suppkey % 4, '-b', l_partkey % 11) AS player_id"]


def _seen(rows: str) -> str:
    return f"""SELECT player_id, name, last_name, game_date AS first_seen, visitor_team, home_team FROM ({rows}) JOIN {_LINKED} USING (game_id) JOIN game USING (game_id) JOIN {_HONOURED} USING (player_id)
    WHERE game_date = logged_date QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) = 1"""


def sightings(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables, with honours, managers and substitutions, and links to games, some of them wrong."""
    t = tables(spark, d)
    honoured = t["people"].withColumns({"hof": F.when(F.col("player_id").like("%-b1%"), "HOF"), "nickname": F.lit("")})
    managed = t["game_log"].withColumns({f"{s}_manager_id": F.concat(f"{s}_team", F.lit("-b1")) for s in ("visitor", "home")})
    subs = _table(spark, d, "lineitem").filter("l_linenumber = 2").selectExpr(*_SUBS)
    return t | {"people": honoured, "game_log": managed, "substitution": subs}, _table(spark, d, "orders").filter("o_custkey % 3 = 0").selectExpr(*_LINKS)


@query(f"SELECT game_id, logged_date, game_date AS points_to FROM {_LINKED} LEFT JOIN game USING (game_id) WHERE game_date IS NULL OR game_date <> logged_date")
def study_bad_links(spark, d):
    return studies.bad_links(*sightings(spark, d))


@query(_seen(f"SELECT game_id, player_id FROM lineup_start UNION ALL SELECT {', '.join(_SUBS)} FROM lineitem WHERE l_linenumber = 2"))
def study_first_sightings(spark, d):
    return studies.first_sightings(*sightings(spark, d))


@query(_seen("SELECT game_id, concat(visitor_team, '-b1') AS player_id FROM game_log UNION ALL SELECT game_id, concat(home_team, '-b1') FROM game_log"))
def study_first_managers(spark, d):
    return studies.first_managers(*sightings(spark, d))


#: Years of a look-up relation: those of two clubs' players, the others without one.
INDUCTED = {"T0-b1": 1999, "T2-b1": 1989, "T2-b10": 1999}


@query("SELECT *, CASE player_id " + " ".join(f"WHEN '{p}' THEN {y}" for p, y in INDUCTED.items()) + " END AS inducted FROM (" + _seen(f"SELECT game_id, player_id FROM lineup_start UNION ALL SELECT {', '.join(_SUBS)} FROM lineitem WHERE l_linenumber = 2") + ")")
def study_sightings_by_induction(spark, d):
    return studies.by_induction(studies.first_sightings(*sightings(spark, d)), INDUCTED)


# --- workload and support -----------------------------------------------------


@query(f"""SELECT year(game_date) AS season, count(*) AS gs, {_rate('sum(batters_faced)', 'count(*)', 2)} AS bf_per_start, count(*) FILTER (WHERE runs <= 1) AS starts_good, {_rate('sum(batters_faced) FILTER (WHERE runs <= 1)', 'count(*) FILTER (WHERE runs <= 1)', 2)} AS bf_per_good_start,
  {_rate('sum(outs) FILTER (WHERE runs <= 1)', '3 * count(*) FILTER (WHERE runs <= 1)', 2)} AS ip_per_good_start, count(*) FILTER (WHERE runs <= 1 AND batters_faced < 3) AS pulled_early, {_rate('count(*) FILTER (WHERE runs <= 1 AND batters_faced < 3)', 'count(*) FILTER (WHERE runs <= 1)', 1, 100)} AS pct_pulled_early
FROM pitching_daily WHERE player_id = '{PITCHER}' AND games_started AND game_id IN {_REG} GROUP BY ALL HAVING count(*) >= 3""")
def study_workload_when_effective(spark, d):
    return studies.workload_when_effective(tables(spark, d), PITCHER, most_runs=1, whole_game=3, least_starts=3)


def _era(r: str, o: str) -> str:
    return _rate(f"{r} * er", f"{o} * ra", 2, 27)


@query(f"""SELECT season, gs, {_rate('o1', '3', 1)} AS ip_first, CAST(r1 AS BIGINT) AS runs_first, {_era('r1', 'o1')} AS era_first, {_rate('o - o1', '3', 1)} AS ip_after, CAST(r - r1 AS BIGINT) AS runs_after, {_era('(r - r1)', '(o - o1)')} AS era_after, {_era('r', 'o')} AS era_full, {_rate('o - o1', 'o', 1, 100)} AS pct_ip_after
FROM (SELECT season, count(DISTINCT game_id) AS gs, sum(CASE WHEN number <= 1 THEN outs_on_play ELSE 0 END) AS o1, sum(CASE WHEN number <= 1 THEN runs_on_play ELSE 0 END) AS r1, sum(outs_on_play) AS o, sum(runs_on_play) AS r FROM (
  SELECT game_id, year(s.game_date) AS season, outs_on_play, runs_on_play, sum(CASE WHEN event_code < 4 OR event_code > 13 THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY play_seq) + CASE WHEN event_code < 4 OR event_code > 13 THEN 0 ELSE 1 END AS number
  FROM play JOIN (SELECT game_id, game_date FROM pitching_daily WHERE player_id = '{PITCHER}' AND games_started AND game_id IN {_REG}) s USING (game_id) WHERE pitcher_id = '{PITCHER}') GROUP BY season HAVING count(DISTINCT game_id) >= 3)
JOIN (SELECT year(game_date) AS season, sum(earned_runs) AS er, sum(runs) AS ra FROM pitching_daily WHERE player_id = '{PITCHER}' GROUP BY ALL) USING (season)""")
def study_times_through(spark, d):
    return studies.times_through_split(tables(spark, d), PITCHER, batters=1, least_starts=3)


@query()
def season_sketches(spark, d):
    """Distinct batters, and quantiles of the batters that pitchers faced in a game, by season, from sketches of each day; approximate,
    so without SQL."""
    t = tables(spark, d)
    rows = t["batting_daily"].select(F.lit("batters").alias("kind"), "game_date", "player_id", F.lit(None).cast("int").alias("faced"))
    rows = rows.unionByName(t["pitching_daily"].select(F.lit("pitchers").alias("kind"), "game_date", "player_id", F.col("batters_faced").alias("faced")))
    days = sketches.daily(rows, ["kind"], F.col("game_date"), {"players": F.col("player_id")}, {"faced": F.col("faced")})
    return sketches.merged(days, ["kind", F.year("day").alias("season")], ["players"], {"faced": {"median_faced": 0.5, "p90_faced": 0.9}})


_TEAM_RUNS = f"(SELECT game_id, team, year(game_date) AS season, CAST(sum(runs) AS BIGINT) AS runs FROM batting_daily WHERE game_id IN {_REG} GROUP BY ALL)"


_OWN_START = f"game_id IN (SELECT game_id FROM pitching_daily WHERE player_id = '{PITCHER}' AND games_started AND game_id IN {_REG})"


@query(f"""SELECT CASE WHEN grouping(at_home) = 1 THEN 'TOTAL' WHEN at_home THEN 'home' ELSE 'road' END AS venue, count(*) FILTER (WHERE own) AS own_starts, {_r('avg(runs) FILTER (WHERE own)', 2)} AS runs_own_starts,
  count(*) FILTER (WHERE NOT own) AS other_games, {_r('avg(runs) FILTER (WHERE NOT own)', 2)} AS runs_other_games
FROM (SELECT t.runs, home_team = '{TEAM}' AS at_home, {_OWN_START} AS own FROM {_TEAM_RUNS} t JOIN game USING (game_id) WHERE team = '{TEAM}' AND season = {SEASON}) GROUP BY GROUPING SETS ((at_home), ())""")
def study_run_support(spark, d):
    return studies.run_support(tables(spark, d, [SEASON]), TEAM, PITCHER, SEASON)


@query(f"""SELECT host, count(*) AS games, {_rate('sum(runs)', 'count(*)', 2)} AS runs_per_game FROM (SELECT game_id, home_team AS host, sum(runs) AS runs FROM {_TEAM_RUNS} JOIN game USING (game_id) WHERE season = {SEASON} GROUP BY ALL HAVING count(*) = 2) GROUP BY host""")
def study_runs_by_park(spark, d):
    return studies.runs_by_park(tables(spark, d, [SEASON]), SEASON)


@query(f""", st AS (SELECT game_id, player_id, team FROM pitching_daily WHERE games_started AND year(game_date) = {SEASON} AND game_id IN {_REG}), mine AS (SELECT game_id, player_id FROM st WHERE team = '{TEAM}')
SELECT player_id, gs, support, sd, se, pct_starts_le2, opposing_era FROM (SELECT player_id, count(*) AS gs, {_r('avg(runs)', 2)} AS support, {_r('stddev_samp(runs)', 2)} AS sd, {_r('stddev_samp(runs) / sqrt(count(*))', 2)} AS se, {_rate('count(*) FILTER (WHERE runs <= 2)', 'count(*)', 1, 100)} AS pct_starts_le2
  FROM mine JOIN (SELECT * FROM {_TEAM_RUNS} WHERE team = '{TEAM}') USING (game_id) GROUP BY player_id HAVING count(*) >= 2)
LEFT JOIN (SELECT m.player_id, {_r('avg(er * 27 / o)', 2)} AS opposing_era FROM mine m JOIN st a ON a.game_id = m.game_id AND a.team <> '{TEAM}' JOIN (SELECT player_id, sum(outs) AS o, sum(earned_runs) AS er FROM pitching_daily WHERE year(game_date) = {SEASON} GROUP BY ALL HAVING sum(outs) >= 10) y ON y.player_id = a.player_id GROUP BY m.player_id) USING (player_id)""")
def study_support_by_starter(spark, d):
    return studies.support_by_starter(tables(spark, d, [SEASON]), TEAM, SEASON, least_starts=2, least_outs=10)


@query(f"""SELECT season, {_rate(f"sum(r) FILTER (WHERE team = '{TEAM}')", f"sum(g) FILTER (WHERE team = '{TEAM}')", 2)} AS runs_per_game, max(rank) FILTER (WHERE team = '{TEAM}') AS league_rank, {_rate('sum(r)', 'sum(g)', 2)} AS league_average FROM (
  SELECT *, rank() OVER (PARTITION BY season ORDER BY r / g DESC) AS rank FROM (SELECT season, team, CAST(sum(runs) AS DOUBLE) AS r, count(*) AS g FROM {_TEAM_RUNS} WHERE team IN ({', '.join(f"'{x}'" for x in LEAGUE)}) AND season IN (1995, 1996, 1997) GROUP BY ALL)) GROUP BY season""")
def study_offense_in_context(spark, d):
    out = studies.offense_in_context(tables(spark, d, [1995, 1996, 1997]), TEAM, LEAGUE, [1995, 1996, 1997])
    return out.withColumn("league_rank", F.col("league_rank").cast("long"))


# --- a player's lines -----------------------------------------------------------

PLAYER = "T1-b5"
_BAT = {"pa": "plate_appearances", "ab": "at_bats", "r": "runs", "h": "hits", "2b": "doubles", "3b": "triples", "hr": "home_runs", "rbi": "rbi", "bb": "walks", "so": "strikeouts", "hbp": "hit_by_pitch", "sf": "sac_flies", "sb": "stolen_bases", "cs": "caught_stealing", "tb": "total_bases"}
_PITCH = {"bf": "batters_faced", "h": "hits", "hr": "home_runs", "r": "runs", "er": "earned_runs", "bb": "walks", "so": "strikeouts", "hbp": "hit_by_pitch", "wp": "wild_pitches", "bk": "balks"}
_SUM = lambda kinds: ", ".join(f'CAST(sum({c}) AS BIGINT) AS "{n}"' for n, c in kinds.items())


_LINE = [
    "concat('G', l_orderkey) AS game_id", "concat('T', l_suppkey % 4, '-b', l_partkey % 11) AS player_id", "CAST(o_orderdate AS DATE) AS game_date", "CAST(l_partkey % 9 + 1 AS INT) AS position", "1 AS games",
    "l_linenumber % 2 = 0 AS games_started", *[f"CAST((l_partkey + {k} * l_suppkey) % {n} AS INT) AS {c}" for k, (c, n) in enumerate({"outs": 28, "po": 9, "a": 6, "e": 2, "dp": 3, "tp": 2, "pb": 2, "xi": 2}.items())],
]


def player_tools(spark: SparkSession, d: str) -> tools.Tools:
    """The tools over the derived tables, with fielding lines made of order lines and a batting order."""
    t = tables(spark, d)
    lines = _table(spark, d, "lineitem").join(_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_LINE)
    return tools.Tools(t | {"fielding_daily": lines, "lineup_start": t["lineup_start"].withColumn("batting_order", F.col("fielding_position"))})


@query(f"""SELECT *, {_rate('outs', '3', 1)} AS ip, {_rate('po + a', 'po + a + e', 3)} AS fld_pct FROM (SELECT year(game_date) AS year, position, CAST(sum(games) AS BIGINT) AS g, count(*) FILTER (WHERE games_started) AS gs,
  {_SUM({c: c for c in ("outs", "po", "a", "e", "dp", "tp", "pb", "xi")})} FROM (SELECT {", ".join(_LINE)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE player_id = '{PLAYER}' GROUP BY 1, 2)""")
def player_fielding(spark, d):
    return player_tools(spark, d).player_stats(PLAYER)["fielding"]


@query(f"""SELECT *, {_rate('h', 'ab', 3)} AS avg, {_rate('h + bb + hbp', 'ab + bb + hbp + sf', 3)} AS obp, {_rate('tb', 'ab', 3)} AS slg FROM (SELECT year(game_date) AS year, count(*) AS g, {_SUM(_BAT)} FROM batting_daily WHERE player_id = '{PLAYER}' GROUP BY 1)""")
def player_batting(spark, d):
    return player_tools(spark, d).player_stats(PLAYER)["batting"]


@query(f"""SELECT year, g, gs, w, l, sv, {_rate('outs', '3', 1)} AS ip, * EXCLUDE (year, g, gs, w, l, sv, outs), {_rate('er', 'outs', 2, 27)} AS era, {_rate('bb + h', 'outs', 3, 3)} AS whip FROM (SELECT year(game_date) AS year, count(*) AS g, count(*) FILTER (WHERE games_started) AS gs,
  count(*) FILTER (WHERE won) AS w, count(*) FILTER (WHERE lost) AS l, count(*) FILTER (WHERE saved) AS sv, CAST(sum(outs) AS BIGINT) AS outs, {_SUM(_PITCH)} FROM pitching_daily WHERE player_id = '{PITCHER}' GROUP BY 1)""")
def player_pitching(spark, d):
    return player_tools(spark, d).player_stats(PITCHER)["pitching"]


@query(f"""SELECT b.*, visitor_team, home_team FROM batting_daily b JOIN game USING (game_id) WHERE player_id = '{PLAYER}' ORDER BY b.game_date, game_id LIMIT 200""")
def player_game_log(spark, d):
    return player_tools(spark, d).player_game_log(PLAYER, "batting")


@query(f"""SELECT game_id, game_date, visitor_team, home_team, side, fielding_position AS batting_order, fielding_position FROM lineup_start JOIN game USING (game_id) WHERE player_id = '{PLAYER}' AND year(game_date) = {SEASON} ORDER BY game_date, game_id LIMIT 200""")
def player_games(spark, d):
    return player_tools(spark, d).player_games(PLAYER, SEASON)
