"""Queries that put the grammar, the replay, the daily lines and the studies to work on whole tables.

The tables of an archive are derived from the star schema: an order is a game, its lines are the plays, and each
line's part chooses an event. Spark parses that event; the equal SQL looks the expected fields up in ``EVENTS``
instead. Where a text of columns means the same to both, both use it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.functions import events as grammar
from dugout.functions.fielding import credits
from dugout.operators.shared import written
from dugout.plans import daily, starters, studies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: event, then what the format says of it: code, hit, at bat, sacrifice fly and hit, double play, wild pitch, outs, rbi, batter on base
EVENTS = (
    ("S8/L8.1-3", 20, 1, True, False, False, False, False, 0, 0, True),
    ("D7/L7LD.2-H;1-3", 21, 2, True, False, False, False, False, 0, 1, True),
    ("HR/F9LD.1-H;2-H", 23, 4, True, False, False, False, False, 0, 3, True),
    ("K", 3, 0, True, False, False, False, False, 1, 0, False),
    ("W", 14, 0, False, False, False, False, False, 0, 0, True),
    ("63/G6", 2, 0, True, False, False, False, False, 1, 0, False),
    ("64(1)3/GDP", 2, 0, True, False, False, True, False, 2, 0, False),
    ("8/SF.3-H", 2, 0, False, True, False, False, False, 1, 1, False),
    ("23/SH.1-2", 2, 0, False, False, True, False, False, 1, 0, False),
    ("WP.3-H", 9, 0, False, False, False, False, True, 0, 0, False),
    ("SB2", 4, 0, False, False, False, False, False, 0, 0, False),
    ("E6.1-2", 18, 0, True, False, False, False, False, 0, 0, True),
    ("HP.3-H", 16, 0, False, False, False, False, False, 0, 1, True),
    ("CS2(26)", 6, 0, False, False, False, False, False, 1, 0, False),
    ("IW", 15, 0, False, False, False, False, False, 0, 0, True),
    ("T9.1-H(E9);2-H", 22, 3, True, False, False, False, False, 0, 1, True),
    ("SBH", 4, 0, False, False, False, False, False, 0, 0, False),
)
_FIELDS = ("event_code", "hit_value", "at_bat", "sac_fly", "sac_hit", "double_play", "wild_pitch", "outs_on_play", "rbi", "batter_reached")
_PARSED = ("event", *_FIELDS)


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else "NULL" if value is None else str(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


# --- tables: texts of columns that both engines read ---------------------------

_TEAM = {"visitor_team": "concat('T', {c} % 4)", "home_team": "concat('T', ({c} + 1 + {o} % 3) % 4)"}
_SIDES = [f"{e.format(c='o_custkey', o='o_orderkey')} AS {n}" for n, e in _TEAM.items()]
GAME = [
    "concat('G', o_orderkey) AS game_id", "CAST(o_orderdate AS DATE) AS game_date", *_SIDES,
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'exhibition' WHEN '2-HIGH' THEN NULL ELSE 'regular' END AS game_type", "CAST(o_custkey AS INT) AS attendance",
    f"concat({_TEAM['visitor_team'].format(c='o_custkey', o='o_orderkey')}, '-s', o_orderkey % 3) AS winning_pitcher",
    f"concat({_TEAM['home_team'].format(c='o_custkey', o='o_orderkey')}, '-s', o_orderkey % 3) AS losing_pitcher", "CAST(NULL AS STRING) AS save_pitcher",
]
_SEQ = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS play_seq"
_EVENT = "CAST(l_partkey % 17 AS INT) AS k"
_PLACED = [
    "concat('G', l_orderkey) AS game_id", "play_seq", "l_orderkey", "l_partkey", "l_suppkey", "CASE WHEN play_seq <= 2 THEN 1 ELSE 2 END AS inning",
    "CAST((l_orderkey + CASE WHEN play_seq IN (1, 3, 4, 5) THEN 0 ELSE 1 END) % 2 AS INT) AS half", *_SIDES, _EVENT,
]
_TEAMS = ["*", "CASE WHEN half = 0 THEN visitor_team ELSE home_team END AS bats", "CASE WHEN half = 0 THEN home_team ELSE visitor_team END AS fields"]
_STATE = [
    *["game_id", "play_seq", "inning", "half", "k"], "concat(bats, '-b', l_partkey % 6 + 4) AS batter_id",
    "CASE WHEN play_seq > 3 THEN concat(fields, '-r') ELSE concat(fields, '-s', l_orderkey % 3) END AS pitcher_id",
    "CASE WHEN l_suppkey % 4 = 0 THEN concat(bats, '-b1') END AS base1_before", "CASE WHEN l_suppkey % 4 = 1 THEN concat(bats, '-b1') END AS base2_before",
    "CASE WHEN l_suppkey % 3 = 0 THEN concat(bats, '-b3') END AS base3_before",
    "CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_partkey % 5 AS INT) ELSE 0 END AS run1_dest", "CASE WHEN l_suppkey % 4 = 1 THEN CAST(2 + l_partkey % 3 AS INT) ELSE 0 END AS run2_dest",
    "CASE WHEN l_suppkey % 3 = 0 THEN CAST(3 + l_partkey % 2 AS INT) ELSE 0 END AS run3_dest",
]
_MOVED = ["*", "CASE WHEN hit_value > 0 THEN hit_value WHEN batter_reached THEN 1 ELSE 0 END AS batter_dest"]
_SCORED = ["*", "CAST(" + " + ".join(f"CASE WHEN {d} = 4 THEN 1 ELSE 0 END" for d in ("batter_dest", "run1_dest", "run2_dest", "run3_dest")) + " AS INT) AS runs_on_play"]
_RUNNING = ["*", *[
    f"coalesce(sum(CASE WHEN half = {h} THEN runs_on_play ELSE 0 END) OVER (PARTITION BY game_id ORDER BY play_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {s}_score_before"
    for h, s in enumerate(("away", "home"))
]]
LOG = ["concat('G', o_orderkey) AS game_id", "CAST(o_orderdate AS DATE) AS game_date", *_SIDES, "CAST(o_custkey % 7 AS INT) AS visitor_score", "CAST(o_orderkey % 5 AS INT) AS home_score"]
EARNED = ["concat('G', l_orderkey) AS game_id", "concat('T', l_suppkey % 4, '-s', l_orderkey % 3) AS player_id", "CAST(l_partkey % 3 AS INT) AS earned_runs"]
_STARTER = "concat(CASE WHEN s = 0 THEN {visitor_team} ELSE {home_team} END, CASE WHEN p = 1 THEN '-s' ELSE '-b' END, CASE WHEN p = 1 THEN o_orderkey % 3 ELSE (o_orderkey + p * (1 + o_custkey % 2)) % 11 END)"
LINEUP = [
    "concat('G', o_orderkey) AS game_id", _STARTER.format(**{n: e.format(c="o_custkey", o="o_orderkey") for n, e in _TEAM.items()}) + " AS player_id",
    "CAST(s AS SMALLINT) AS side", "CAST(p AS SMALLINT) AS fielding_position",
]
PEOPLE = ["player_id", "upper(player_id) AS first_name", "lower(player_id) AS last_name", "'R' AS bats", "CASE WHEN player_id LIKE '%-s0' THEN 'L' ELSE 'R' END AS throws"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Lines that one task numbers and counts: what it holds is bounded by this, not by the input.
LINES_A_PART = 150_000


def raw_plays(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The plays before they are parsed: state, and the event's text. They are cut by game once, into parts of bounded size, so
    that numbers, orders, scores and sums by game need no other shuffle."""
    parts = max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_PART))
    order = Window.partitionBy("game_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    cut = lines.select(F.expr(_PLACED[0]), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").repartition(parts, "game_id")
    numbered = cut.select("game_id", "l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(order).alias("play_seq"))
    placed = numbered.join(orders.selectExpr(GAME[0], "o_orderkey", "o_custkey"), "game_id").selectExpr("game_id", *_PLACED[1:]).selectExpr(*_TEAMS).selectExpr(*_STATE)
    return placed.withColumn("event", _text("k"))


def _text(k: str) -> Column:
    return F.get(F.array(*[F.lit(e[0]) for e in EVENTS]), F.col(k))


def _parsed(plays: DataFrame, lines: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The plays with what ``parse`` adds to their events; the events are those of all lines, with an order or without."""
    return grammar.once(plays, parse, of=lines.selectExpr(_EVENT).select(_text("k").alias("event")))


def tables(spark: SparkSession, d: str, seasons: Sequence[int] | None = None) -> dict[str, DataFrame]:
    """The derived tables; with ``seasons``, like ``Store.tables``, the games of these only. Their lines are then written, once."""
    orders, lines = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    if seasons is not None:
        orders = orders.filter(F.year(F.col("o_orderdate").cast("date")).isin(list(seasons)))
        theirs = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        lines = written(theirs, "lines")
    parsed = _parsed(raw_plays(orders, lines), lines, lambda df: grammar.parse_events(df).select("event", *_FIELDS))
    t = {"game": orders.selectExpr(*GAME), "game_log": orders.selectExpr(*LOG), "earned_runs": lines.selectExpr(*EARNED)}
    t["play"] = parsed.selectExpr(*_MOVED).selectExpr(*_SCORED).selectExpr(*_RUNNING)
    places = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).alias("p")) for s in (0, 1) for p in range(1, 10)])
    t["lineup_start"] = orders.select("o_orderkey", "o_custkey", F.inline(places)).selectExpr(*LINEUP)
    t["people"] = t["lineup_start"].select("player_id").distinct().selectExpr(*PEOPLE)
    t["teams"] = t["game"].select(F.col("home_team").alias("team_id")).distinct().selectExpr("team_id", "lower(team_id) AS city", "'Nine' AS nickname")
    t["batting_daily"] = daily.batting_daily(t["play"], t["game"])
    t["pitching_daily"] = daily.pitching_daily(t["play"], t["game"], t["earned_runs"], t["lineup_start"])
    return t


def _select(columns, source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


_PA = "(event_code IN (2, 3, 14, 15, 16, 17, 18, 19) OR hit_value > 0)"
_BATTING = {
    "plate_appearances": _PA, "at_bats": "at_bat", "hits": "hit_value > 0", "doubles": "hit_value = 2", "triples": "hit_value = 3", "home_runs": "hit_value = 4",
    "walks": "event_code IN (14, 15)", "intentional_walks": "event_code = 15", "strikeouts": "event_code = 3", "hit_by_pitch": "event_code = 16",
    "sac_hits": "sac_hit", "sac_flies": "sac_fly", "gidp": "double_play",
}
_PITCHING = {
    "batters_faced": _PA, "hits": "hit_value > 0", "home_runs": "hit_value = 4", "walks": "event_code IN (14, 15)", "intentional_walks": "event_code = 15",
    "strikeouts": "event_code = 3", "hit_by_pitch": "event_code = 16", "wild_pitches": "wild_pitch", "balks": "event_code = 11",
}
_COUNTS = lambda kinds: ", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS INT) AS {n}" for n, c in kinds.items())
_ROLES = " UNION ALL ".join(
    f"SELECT game_id, half, base{b}_before AS player_id, run{b}_dest AS dest, event LIKE '%SB{to}%' AS stole, event LIKE '%CS{to}%' AS caught FROM play WHERE base{b}_before IS NOT NULL"
    for b, to in (("1", "2"), ("2", "3"), ("3", "H"))
)
#: The same tables in SQL, each as a text of a WITH clause; Spark's parser is replaced by a look-up of the expected fields.
_CTES = {
    "e": f"SELECT * FROM (VALUES {_values((k, *e) for k, e in enumerate(EVENTS))}) AS v(k, {', '.join(_PARSED)})",
    "game": _select(GAME, "orders"),
    "game_log": _select(LOG, "orders"),
    "earned_runs": _select(EARNED, "lineitem"),
    "lineup_start": _select(LINEUP, "orders, (SELECT unnest([0, 1]) AS s), (SELECT unnest(range(1, 10)) AS p)"),
    "people": _select(PEOPLE, "(SELECT DISTINCT player_id FROM lineup_start)"),
    "seqs": _select(["l_orderkey", "l_partkey", "l_suppkey", _SEQ], "lineitem"),
    "placed": _select(_PLACED, "seqs JOIN orders ON l_orderkey = o_orderkey"),
    "state": _select(_STATE, f"({_select(_TEAMS, 'placed')})"),
    "moved": _select(_MOVED, "(SELECT s.*, e.* EXCLUDE (k) FROM state s JOIN e ON e.k = s.k)"),
    "play": _select(_RUNNING, f"({_select(_SCORED, 'moved')})"),
    "batting_daily": f"""SELECT game_id, player_id, CASE WHEN side = 0 THEN visitor_team ELSE home_team END AS team, game_date, side, x.* EXCLUDE (game_id, player_id, side) FROM (
      SELECT coalesce(b.game_id, r.game_id) AS game_id, coalesce(b.player_id, r.player_id) AS player_id, coalesce(b.side, r.side) AS side,
        {", ".join(f"coalesce({n}, 0) AS {n}" for n in [*_BATTING, "rbi", "total_bases", "stolen_bases", "caught_stealing"])}, CAST(coalesce(own, 0) + coalesce(others, 0) AS INT) AS runs
      FROM (SELECT game_id, batter_id AS player_id, half AS side, {_COUNTS(_BATTING)}, CAST(sum(rbi) AS INT) AS rbi, CAST(sum(hit_value) AS INT) AS total_bases,
          count(*) FILTER (WHERE batter_dest = 4) AS own FROM play GROUP BY ALL) b
      FULL JOIN (SELECT game_id, player_id, half AS side, {_COUNTS({"others": "dest = 4", "stolen_bases": "stole", "caught_stealing": "caught"})} FROM ({_ROLES}) GROUP BY ALL) r
        ON b.game_id = r.game_id AND b.player_id = r.player_id) x JOIN game USING (game_id)""",
    "pitching_daily": f"""SELECT game_id, player_id, CASE WHEN side = 0 THEN visitor_team ELSE home_team END AS team, game_date, side, coalesce(started, false) AS games_started,
      p.* EXCLUDE (game_id, player_id, side), er AS earned_runs, coalesce(winning_pitcher = player_id, false) AS won, coalesce(losing_pitcher = player_id, false) AS lost, coalesce(save_pitcher = player_id, false) AS saved
      FROM (SELECT game_id, pitcher_id AS player_id, 1 - half AS side, CAST(sum(outs_on_play) AS INT) AS outs, CAST(sum(runs_on_play) AS INT) AS runs, {_COUNTS(_PITCHING)} FROM play WHERE pitcher_id IS NOT NULL GROUP BY ALL) p
      JOIN game USING (game_id) LEFT JOIN (SELECT game_id, player_id, CAST(sum(earned_runs) AS INT) AS er FROM earned_runs GROUP BY ALL) USING (game_id, player_id)
      LEFT JOIN (SELECT DISTINCT game_id, player_id, true AS started FROM lineup_start WHERE fielding_position = 1) USING (game_id, player_id)""",
}
_BATTING_COLUMNS = ["game_id", "player_id", "team", "game_date", "side", *_BATTING, "rbi", "total_bases", "stolen_bases", "caught_stealing", "runs"]


def _sql(body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in _CTES.items()) + " " + body


def query(sql: str | None = None):
    """Registers a query; its SQL is a body behind the tables' WITH clause, or whole if it starts with its own."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: _plain(f(spark, d))
        if sql:
            SQL[f.__name__] = sql.removeprefix("!") if sql.startswith("!") else _sql(sql)
        return f

    return register


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, as the SQL has them."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


def _r(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(20,8)), {digits}) AS DOUBLE)"


def _rate(top: str, bottom: str, digits: int, factor: int = 1) -> str:
    return _r(f"{factor}.0 * ({top}) / nullif({bottom}, 0)", digits)


# --- grammar ----------------------------------------------------------


@query("""SELECT event, count(*) AS n, CAST(sum(len(regexp_extract_all(event, '[B123]-H')) + CASE WHEN regexp_matches(split_part(event, '.', 1), '^(HR|H)([^A-Za-z]|$)') AND NOT contains(event, 'B-H') THEN 1 ELSE 0 END
  + greatest(0, len(regexp_extract_all(event, 'SBH')) - CASE WHEN contains(event, '3-H') THEN 1 ELSE 0 END)) AS BIGINT) AS runs FROM play GROUP BY event""")
def derived_runs(spark, d):
    return raw_plays(_table(spark, d, "orders"), _table(spark, d, "lineitem")).groupBy("event").agg(F.count("*").alias("n"), F.sum(grammar.derived_runs(F.col("event"))).cast("long").alias("runs"))


#: Credits of the fielders of each event, by the format's rules: position, kind.
CREDITS = {
    "K": ((2, "po"),), "63/G6": ((6, "a"), (3, "po")), "64(1)3/GDP": ((6, "a"), (4, "po"), (4, "a"), (3, "po")), "8/SF.3-H": ((8, "po"),),
    "23/SH.1-2": ((2, "a"), (3, "po")), "E6.1-2": ((6, "e"),), "CS2(26)": ((2, "a"), (6, "po")), "T9.1-H(E9);2-H": ((9, "e"),),
}


@query(f"""SELECT pitcher_id, position, kind, count(*) AS n FROM play JOIN (VALUES {_values((e, p, k) for e, c in CREDITS.items() for p, k in c)}) AS c(event, position, kind) USING (event) GROUP BY ALL""")
def fielding_credits(spark, d):
    """Credits of all plays, by pitcher, position and kind: plays are counted by pitcher and event before they have any."""
    lines = _table(spark, d, "lineitem")
    counted = raw_plays(_table(spark, d, "orders"), lines).groupBy("pitcher_id", "event").agg(F.count("*").alias("_plays"))
    parsed = _parsed(counted, lines, lambda df: grammar.parse_events(df).select("event", credits().alias("credits")))
    return parsed.select("pitcher_id", "_plays", F.inline("credits")).groupBy("pitcher_id", "position", "kind").agg(F.sum("_plays").alias("n"))


# --- daily lines and studies over derived games -----------------------------------


@query(f"SELECT {', '.join(_BATTING_COLUMNS)} FROM batting_daily")
def batting_daily(spark, d):
    return tables(spark, d)["batting_daily"].select(*_BATTING_COLUMNS)


@query("SELECT * FROM pitching_daily")
def pitching_daily(spark, d):
    return tables(spark, d)["pitching_daily"]


TEAM, PITCHER, SEASON, LEAGUE = "T1", "T1-s0", 1996, ["T0", "T1", "T2"]
_REG = "(SELECT game_id FROM game WHERE game_type IS NULL OR game_type = 'regular')"
_MINE = f"SELECT * FROM pitching_daily WHERE player_id = '{PITCHER}' AND games_started AND year(game_date) = {SEASON}"
_START = f"{_MINE} AND game_id IN {_REG}"
_OWN = f"game_id IN (SELECT game_id FROM ({_MINE}))"
_GAMES = f"""SELECT game_id, home_team = '{TEAM}' AS at_home, CASE WHEN home_team = '{TEAM}' THEN 1 ELSE 0 END AS side, {_OWN} AS own_start FROM game
  WHERE '{TEAM}' IN (home_team, visitor_team) AND game_id IN {_REG} AND year(game_date) = {SEASON}"""
_VENUE = "CASE WHEN at_home THEN 'home' ELSE 'road' END AS venue"


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS relievers, {_rate('sum(outs)', '3', 1)} AS ip, CAST(sum(runs) AS BIGINT) AS runs_allowed, {_rate('sum(runs)', 'sum(outs)', 2, 27)} AS ra9 FROM pitching_daily WHERE NOT games_started AND team IN ('T0', 'T1', 'T2') AND year(game_date) = {SEASON} AND game_id IN {_REG} AND {c}"
    for name, c in {"league": "true", "team": f"team = '{TEAM}'", "team, his starts": f"team = '{TEAM}' AND {_OWN}", "team, other starts": f"team = '{TEAM}' AND NOT {_OWN}"}.items()
))
def bullpen_split(spark, d):
    return starters.bullpen_split(tables(spark, d, [SEASON]), LEAGUE, TEAM, PITCHER, SEASON)


@query(f"""SELECT s.game_id, s.game_date, s.batters_faced AS bf, {_rate('s.outs', '3', 1)} AS ip, during.n AS runs_during, coalesce(lft.n, 0) AS runners_left_on, coalesce(sc.n, 0) AS bequeathed_scored, s.runs AS charged_r, s.earned_runs AS charged_er
FROM ({_START}) s JOIN (SELECT game_id, CAST(sum(runs_on_play) AS BIGINT) AS n, max(play_seq) AS z FROM play WHERE pitcher_id = '{PITCHER}' GROUP BY ALL) during USING (game_id)
LEFT JOIN (SELECT game_id, count(*) AS n FROM (
    SELECT p.game_id, unnest([base1_before, base2_before, base3_before, batter_id]) AS who, unnest([run1_dest, run2_dest, run3_dest, batter_dest]) AS dest FROM play p JOIN (SELECT game_id, max(play_seq) AS z FROM play WHERE pitcher_id = '{PITCHER}' GROUP BY ALL) l ON p.game_id = l.game_id AND p.play_seq = z)
  WHERE who IS NOT NULL AND dest BETWEEN 1 AND 3 GROUP BY ALL) lft USING (game_id)
LEFT JOIN (SELECT x.game_id, count(*) AS n FROM (
    SELECT p.game_id, z, inning, half, unnest([base1_before, base2_before, base3_before, batter_id]) AS who, unnest([run1_dest, run2_dest, run3_dest, batter_dest]) AS dest FROM play p JOIN (SELECT game_id, max(play_seq) AS z FROM play WHERE pitcher_id = '{PITCHER}' GROUP BY ALL) l ON p.game_id = l.game_id AND p.play_seq = z) x
  JOIN (SELECT game_id, play_seq, inning, half, unnest([base1_before, base2_before, base3_before]) AS who, unnest([run1_dest, run2_dest, run3_dest]) AS dest FROM play) y
  ON x.game_id = y.game_id AND x.inning = y.inning AND x.half = y.half AND x.who = y.who AND y.play_seq > z WHERE x.dest BETWEEN 1 AND 3 AND y.dest >= 4 GROUP BY ALL) sc USING (game_id)""")
def bequeathed_runners(spark, d):
    return starters.bequeathed_runners(tables(spark, d, [SEASON]), PITCHER, SEASON)


@query(f"""SELECT starters, count(*) FILTER (WHERE x > 0) AS exits_with_lead, count(*) FILTER (WHERE x > 0 AND f > 0) AS leads_held, {_rate('count(*) FILTER (WHERE x > 0 AND f > 0)', 'count(*) FILTER (WHERE x > 0)', 1, 100)} AS pct_leads_held,
  count(*) FILTER (WHERE x = 0) AS exits_tied, {_rate('count(*) FILTER (WHERE x = 0 AND f > 0)', 'count(*) FILTER (WHERE x = 0)', 1, 100)} AS pct_tied_won FROM (
  SELECT CASE WHEN st.player_id = '{PITCHER}' THEN 'pitcher' WHEN st.team = '{TEAM}' THEN 'team' ELSE 'league' END AS starters, CASE WHEN st.team = home_team THEN 1 ELSE -1 END * (coalesce(nxt.home_score_before, home_f) - coalesce(nxt.away_score_before, away_f)) AS x,
    CASE WHEN st.team = home_team THEN 1 ELSE -1 END * (home_f - away_f) AS f
  FROM (SELECT * FROM pitching_daily WHERE games_started AND team IN ('T0', 'T1', 'T2') AND year(game_date) = {SEASON} AND game_id IN {_REG}) st JOIN game USING (game_id)
  JOIN (SELECT game_id, pitcher_id AS player_id, max(play_seq) AS z FROM play GROUP BY ALL) l USING (game_id, player_id)
  JOIN (SELECT game_id, max(away_score_before + CASE WHEN half = 0 THEN runs_on_play ELSE 0 END) AS away_f, max(home_score_before + CASE WHEN half = 1 THEN runs_on_play ELSE 0 END) AS home_f FROM play GROUP BY ALL) f USING (game_id)
  LEFT JOIN play nxt ON nxt.game_id = st.game_id AND nxt.play_seq = z + 1) GROUP BY ALL""")
def lead_holding(spark, d):
    return starters.lead_holding(tables(spark, d, [SEASON]), LEAGUE, TEAM, PITCHER, SEASON)


@query(f"""SELECT s.game_id, s.game_date, CASE WHEN home_team = s.team THEN concat('vs ', visitor_team) ELSE concat('at ', home_team) END AS opponent, batters_faced AS bf, {_rate('outs', '3', 1)} AS ip, runs AS r, earned_runs AS er, strikeouts AS so, walks AS bb,
  {_rate('coalesce(po, 0)', '3', 1)} AS pen_ip, coalesce(pr, 0) AS pen_runs, CASE WHEN won THEN 'W' WHEN lost THEN 'L' ELSE '-' END AS decision
FROM ({_START}) s JOIN game USING (game_id) LEFT JOIN (SELECT game_id, team, CAST(sum(outs) AS BIGINT) AS po, CAST(sum(runs) AS BIGINT) AS pr FROM pitching_daily WHERE player_id <> '{PITCHER}' GROUP BY ALL) o ON o.game_id = s.game_id AND o.team = s.team""")
def start_log(spark, d):
    return starters.start_log(tables(spark, d, [SEASON]), PITCHER, SEASON)


@query(f"""SELECT CASE WHEN won THEN 'Win' WHEN lost THEN 'Loss' ELSE 'No decision' END AS decision, count(*) AS games, {_rate('sum(outs)', '3 * count(*)', 2)} AS avg_ip, {_rate('sum(s.runs)', 'count(*)', 2)} AS avg_runs_allowed,
  {_rate('sum(b.runs)', 'count(*)', 2)} AS avg_runs_scored, count(*) FILTER (WHERE s.runs <= 2) AS games_allowed_few, count(*) FILTER (WHERE b.runs <= 2) AS games_scored_few
FROM ({_START}) s JOIN (SELECT game_id, team, sum(runs) AS runs FROM batting_daily GROUP BY ALL) b USING (game_id, team) GROUP BY ALL""")
def support_by_decision(spark, d):
    return starters.support_by_decision(tables(spark, d, [SEASON]), PITCHER, SEASON)


_LINES = f"SELECT g.*, player_id, fielding_position FROM lineup_start l JOIN ({_GAMES}) g ON g.game_id = l.game_id AND g.side = l.side WHERE fielding_position BETWEEN 2 AND 9"
_REGULARS = f"SELECT player_id, count(*) AS total_starts FROM ({_LINES}) GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 8"


@query(f"""SELECT {_VENUE}, own_start, count(*) AS games, {_rate('sum(n)', 'count(n)', 2)} AS avg_regulars, {_rate('count(*) FILTER (WHERE c > 0)', 'count(*)', 1, 100)} AS pct_catcher, {_r('avg(era)', 2)} AS avg_opposing_era
FROM ({_GAMES}) g LEFT JOIN (SELECT game_id, count(*) FILTER (WHERE player_id IN (SELECT player_id FROM ({_REGULARS}))) AS n, count(*) FILTER (WHERE fielding_position = 2 AND player_id = 'T1-b3') AS c FROM ({_LINES}) GROUP BY ALL) USING (game_id)
LEFT JOIN (SELECT game_id, er * 27.0 / o AS era FROM pitching_daily p JOIN (SELECT player_id, sum(outs) AS o, sum(earned_runs) AS er FROM pitching_daily WHERE year(game_date) = {SEASON} GROUP BY ALL HAVING sum(outs) >= 20) USING (player_id)
  WHERE games_started AND team <> '{TEAM}' AND year(game_date) = {SEASON}) USING (game_id) GROUP BY ALL""")
def lineup_checks(spark, d):
    return starters.lineup_checks(tables(spark, d, [SEASON]), TEAM, PITCHER, "T1-b3", SEASON, least_outs=20)


@query(f"""SELECT player_id, concat(upper(player_id), ' ', lower(player_id)) AS player, 'R' AS bats, total_starts, a AS started_own_home, na - a AS missed_own_home, {_rate('a', 'na', 1, 100)} AS pct_own_home, {_rate('b', 'nb', 1, 100)} AS pct_other_home, {_rate('c', 'nc', 1, 100)} AS pct_own_road
FROM ({_REGULARS}) JOIN (SELECT player_id, count(*) FILTER (WHERE at_home AND own_start) AS a, count(*) FILTER (WHERE at_home AND NOT own_start) AS b, count(*) FILTER (WHERE NOT at_home AND own_start) AS c FROM ({_LINES}) GROUP BY ALL) USING (player_id),
  (SELECT count(*) FILTER (WHERE at_home AND own_start) AS na, count(*) FILTER (WHERE at_home AND NOT own_start) AS nb, count(*) FILTER (WHERE NOT at_home AND own_start) AS nc FROM ({_GAMES}))""")
def regulars_rested(spark, d):
    return starters.regulars_rested(tables(spark, d, [SEASON]), TEAM, PITCHER, SEASON)


_FACED = f"""SELECT g.*, runs, throws FROM ({_GAMES}) g JOIN (SELECT game_id, sum(runs) AS runs FROM batting_daily WHERE team = '{TEAM}' AND year(game_date) = {SEASON} GROUP BY ALL) USING (game_id)
  JOIN (SELECT game_id, player_id FROM pitching_daily WHERE games_started AND team <> '{TEAM}' AND year(game_date) = {SEASON}) USING (game_id) JOIN people USING (player_id)"""


@query(f"""SELECT {_VENUE}, own_start, count(*) AS games, count(*) FILTER (WHERE throws = 'L') AS vs_left, {_rate("count(*) FILTER (WHERE throws = 'L')", 'count(*)', 1, 100)} AS pct_vs_left,
  {_r("avg(runs) FILTER (WHERE throws = 'L')", 2)} AS runs_vs_left, {_r("avg(runs) FILTER (WHERE throws = 'R')", 2)} AS runs_vs_right FROM ({_FACED}) GROUP BY ALL""")
def platoon(spark, d):
    return starters.platoon(tables(spark, d, [SEASON]), TEAM, PITCHER, SEASON)


_WELCH = "(avg(runs) FILTER (WHERE {a}) - avg(runs) FILTER (WHERE NOT {a})) / nullif(sqrt(var_samp(runs) FILTER (WHERE {a}) / count(*) FILTER (WHERE {a}) + var_samp(runs) FILTER (WHERE NOT {a}) / count(*) FILTER (WHERE NOT {a})), 0)"


@query(f"""SELECT throws AS opposing_hand, count(*) FILTER (WHERE own_start) AS own_games, {_r('avg(runs) FILTER (WHERE own_start)', 2)} AS own_support, count(*) FILTER (WHERE NOT own_start) AS other_games, {_r('avg(runs) FILTER (WHERE NOT own_start)', 2)} AS other_support,
  {_r('avg(runs) FILTER (WHERE own_start) - avg(runs) FILTER (WHERE NOT own_start)', 2)} AS difference, {_r(_WELCH.format(a='own_start'), 2)} AS t_stat FROM ({_FACED}) WHERE at_home GROUP BY ALL""")
def home_gap_by_hand(spark, d):
    return starters.home_gap_by_hand(tables(spark, d, [SEASON]), TEAM, PITCHER, SEASON)


@query(f"""SELECT {{group}} AS venue, count(*) FILTER (WHERE own_start) AS starts, {_r('avg(runs) FILTER (WHERE own_start)', 2)} AS support, count(*) FILTER (WHERE NOT own_start) AS other_games, {_r('avg(runs) FILTER (WHERE NOT own_start)', 2)} AS other_support,
  {_r(_WELCH.format(a='own_start'), 2)} AS t_stat, {_rate('count(*) FILTER (WHERE own_start AND runs <= 1)', 'count(*) FILTER (WHERE own_start)', 1, 100)} AS pct_starts_le1, {_rate('count(*) FILTER (WHERE NOT own_start AND runs <= 1)', 'count(*) FILTER (WHERE NOT own_start)', 1, 100)} AS pct_others_le1
FROM ({_GAMES}) g JOIN (SELECT game_id, sum(runs) AS runs FROM batting_daily WHERE team = '{TEAM}' GROUP BY ALL) USING (game_id) GROUP BY GROUPING SETS ((at_home), ())""".replace("{group}", "CASE WHEN grouping(at_home) = 1 THEN 'TOTAL' WHEN at_home THEN 'home' ELSE 'road' END"))
def support_test(spark, d):
    return studies.support_test(tables(spark, d, [SEASON]), TEAM, PITCHER, SEASON)


@query(f"""SELECT year(game_date) AS season, count(*) FILTER (WHERE games_started) AS gs, CAST(sum(batters_faced) FILTER (WHERE games_started) AS BIGINT) AS bf_in_starts, {_rate('sum(batters_faced) FILTER (WHERE games_started)', 'count(*) FILTER (WHERE games_started)', 2)} AS bf_per_start,
  {_rate('sum(outs) FILTER (WHERE games_started)', '3 * count(*) FILTER (WHERE games_started)', 2)} AS ip_per_start, count(*) FILTER (WHERE won) AS w, count(*) FILTER (WHERE lost) AS l, {_rate('sum(earned_runs)', 'sum(outs)', 2, 27)} AS era
FROM pitching_daily WHERE player_id = '{PITCHER}' AND game_id IN {_REG} GROUP BY ALL HAVING gs >= 3""")
def workload_by_season(spark, d):
    return studies.workload_by_season(tables(spark, d), PITCHER, least_starts=3)
