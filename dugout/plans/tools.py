"""Named read tools and the filter API over the tables: functions that return DataFrames.

``Tools`` takes any mapping from table names to DataFrames, such as ``Store.tables()``.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from dugout.functions.columns import count_if, rate
from dugout.schemas import LOOKUPS, RELATIONS

ROW_CAP, DEFAULT_ROWS, TIMEOUT_S = 1000, 200, 15


@dataclass
class Answer:
    """Rows of a capped query: those returned, whether there are more, and how many there are if that was asked for."""

    rows: list[dict]
    truncated: bool
    total: int | None = None

    @property
    def returned(self) -> int:
        return len(self.rows)


def _counted(df: DataFrame, cut: Callable[[DataFrame], DataFrame], ordered: bool = False) -> tuple[list[dict], int]:
    """The rows that ``cut`` leaves of ``df``, and the number of all of them, from one pass: a metric is observed below the
    cut. Without an order of its own ``cut`` must read all rows: they are then taken in the order they come in."""
    metric = Observation()
    seen = df.observe(metric, F.count(F.lit(1)).alias("n"))
    if not ordered:
        seen = seen.withColumn("_came", F.monotonically_increasing_id()).orderBy("_came")
    rows = [r.asDict(recursive=True) for r in cut(seen).collect()]
    for r in rows:
        r.pop("_came", None)
    return rows, metric.get["n"]


def capped(df: DataFrame, limit: int = DEFAULT_ROWS, count: bool = False) -> Answer:
    """At most ``limit`` rows (``ROW_CAP`` at most); one more row is fetched to tell if any were left out. With ``count`` all
    rows are read, once, and counted."""
    limit = max(1, min(limit, ROW_CAP))
    if count:
        rows, total = _counted(df, lambda seen: seen.limit(limit))
        return Answer(rows, total > limit, total)
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return Answer(rows[:limit], len(rows) > limit)


def query_sql(
    spark: SparkSession, sql: str, limit: int = DEFAULT_ROWS, timeout: float = TIMEOUT_S, views: Mapping[str, DataFrame] | None = None, count: bool = False
) -> Answer:
    """Run one SELECT or WITH statement and return its rows, capped; with ``count``, also how many there are.

    The text is run as a subquery: there Spark's grammar has no place for a command, an insertion, also one behind
    a WITH, or a second statement, so nothing but a query gets through. ``views`` are known by their names in the text
    only; no view of the session is replaced or left. The job is cancelled after the timeout.
    """
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?is)(select|with)\b", text):
        raise ValueError("only SELECT or WITH queries can be run")
    names = {name: f"view_{uuid.uuid4().hex}" for name in views or {}}
    for name, own in names.items():
        views[name].createTempView(own)
    known = ", ".join(f"`{name}` AS (SELECT * FROM {own})" for name, own in names.items())
    tag = f"query-sql-{threading.get_ident()}"
    spark.addTag(tag)
    timer = threading.Timer(timeout, spark.interruptTag, [tag])
    timer.start()
    try:
        return capped(spark.sql(f"{'WITH ' + known if known else ''} SELECT * FROM (\n{text}\n)"), limit, count)
    finally:
        timer.cancel()
        spark.removeTag(tag)
        for own in names.values():
            spark.catalog.dropTempView(own)


def describe_schema(tables: Mapping[str, DataFrame]) -> list[str]:
    """A line ``table(column type, ...)`` for each table, by name."""
    return [f"{name}({', '.join(f'{c} {kind}' for c, kind in df.dtypes)})" for name, df in sorted(tables.items())]


class Tools:
    def __init__(self, tables: Mapping[str, DataFrame]):
        self.t = tables

    def _one(self, table: str, key: str, value: str) -> dict | None:
        row = self.t[table].filter(F.col(key) == value).limit(1).first()
        return row.asDict() if row else None

    def search_people(self, name: str, limit: int = 25) -> DataFrame:
        """People whose first, last or full name holds the text, in any case; ``%`` and ``_`` are wildcards."""
        full = F.concat_ws(" ", "first_name", "last_name")
        years = {f"{new}_year": F.year(old) for new, old in (("birth", "birth_date"), ("debut", "play_debut"), ("final", "play_last_game"))}
        return (
            self.t["people"]
            .filter(F.ilike("last_name", F.lit(f"%{name}%")) | F.ilike("first_name", F.lit(f"%{name}%")) | F.ilike(full, F.lit(f"%{name}%")))
            .select("player_id", "first_name", "last_name", "nickname", *[v.alias(k) for k, v in years.items()], "bats", "throws", "hof")
            .orderBy(F.asc_nulls_last("last_name"), F.asc_nulls_last("first_name"), "player_id")
            .limit(limit)
        )

    def get_person(self, player_id: str) -> dict | None:
        return self._one("people", "player_id", player_id)

    def get_team(self, team_id: str) -> dict | None:
        return self._one("teams", "team_id", team_id)

    def get_roster(self, team: str, year: int) -> DataFrame:
        rows = self.t["roster"].filter((F.col("team") == team) & (F.col("year") == year))
        return rows.select("player_id", "last_name", "first_name", "bats", "throws", "position").orderBy(F.asc_nulls_last("last_name"), F.asc_nulls_last("first_name"))

    def find_games(self, team=None, year=None, date_from=None, date_to=None, site=None, limit: int = 100) -> DataFrame:
        """Games by the filters given, by date."""
        games = self.t["game"]
        if team is not None:
            games = games.filter((F.col("visitor_team") == team) | (F.col("home_team") == team))
        if year is not None:
            games = games.filter(F.year("game_date") == year)
        if date_from is not None:
            games = games.filter(F.col("game_date") >= F.to_date(F.lit(date_from)))
        if date_to is not None:
            games = games.filter(F.col("game_date") <= F.to_date(F.lit(date_to)))
        if site is not None:
            games = games.filter(F.col("site") == site)
        shown = games.select("game_id", "game_date", "game_number", "visitor_team", "home_team", "site", "day_night", "attendance", "innings")
        return shown.orderBy(F.asc_nulls_last("game_date"), F.asc_nulls_last("game_number"), "game_id").limit(limit)

    def get_game(self, game_id: str) -> dict | None:
        """A game with its starters, substitutions and earned runs."""
        game = self._one("game", "game_id", game_id)
        if game is None:
            return None
        of = lambda table, *order: [r.asDict() for r in self.t[table].filter(F.col("game_id") == game_id).orderBy(*order).collect()]
        return game | {"starters": of("lineup_start", "side", "batting_order"), "substitutions": of("substitution", "seq"), "earned_runs": of("earned_runs", "player_id")}

    def _of_player(self, table: str, player_id: str, year: int | None) -> DataFrame:
        rows = self.t[table].filter(F.col("player_id") == player_id).withColumn("year", F.year("game_date"))
        return rows if year is None else rows.filter(F.col("year") == year)

    def player_stats(self, player_id: str, year: int | None = None) -> dict[str, DataFrame]:
        """Lines by year: batting, pitching, and fielding by year and position. Rates are decimals, null over zero."""
        total = lambda names: [F.sum(c).alias(a) for a, c in names.items()]
        bat = self._of_player("batting_daily", player_id, year).groupBy("year").agg(F.count("*").alias("g"), *total({
            "pa": "plate_appearances", "ab": "at_bats", "r": "runs", "h": "hits", "2b": "doubles", "3b": "triples", "hr": "home_runs", "rbi": "rbi",
            "bb": "walks", "so": "strikeouts", "hbp": "hit_by_pitch", "sf": "sac_flies", "sb": "stolen_bases", "cs": "caught_stealing", "tb": "total_bases",
        }))
        bat = bat.select("*", rate("h", "ab").alias("avg"), rate(F.expr("h + bb + hbp"), F.expr("ab + bb + hbp + sf")).alias("obp"), rate("tb", "ab").alias("slg"))
        pitch = self._of_player("pitching_daily", player_id, year).groupBy("year").agg(
            F.count("*").alias("g"), count_if(F.col("games_started")).alias("gs"), count_if(F.col("won")).alias("w"), count_if(F.col("lost")).alias("l"),
            count_if(F.col("saved")).alias("sv"), *total({
                "outs": "outs", "bf": "batters_faced", "h": "hits", "hr": "home_runs", "r": "runs", "er": "earned_runs", "bb": "walks", "so": "strikeouts",
                "hbp": "hit_by_pitch", "wp": "wild_pitches", "bk": "balks",
            }),
        )
        pitch = pitch.select(
            "year", "g", "gs", "w", "l", "sv", rate("outs", F.lit(3), 1).alias("ip"), "bf", "h", "hr", "r", "er", "bb", "so", "hbp", "wp", "bk",
            rate("er", "outs", 2, 27).alias("era"), rate(F.expr("bb + h"), "outs", 3, 3).alias("whip"),
        )
        field = self._of_player("fielding_daily", player_id, year).groupBy("year", "position").agg(
            F.sum("games").alias("g"), count_if(F.col("games_started")).alias("gs"), *total({c: c for c in ("outs", "po", "a", "e", "dp", "tp", "pb", "xi")})
        )
        field = field.select("*", rate("outs", F.lit(3), 1).alias("ip"), rate(F.expr("po + a"), F.expr("po + a + e")).alias("fld_pct"))
        return {"batting": bat.orderBy("year"), "pitching": pitch.orderBy("year"), "fielding": field.orderBy("year", "position")}

    def player_game_log(self, player_id: str, kind: str, year: int | None = None, limit: int = DEFAULT_ROWS) -> DataFrame:
        """A player's daily lines of a kind (batting, pitching or fielding) with the game's teams, by date."""
        if kind not in ("batting", "pitching", "fielding"):
            raise ValueError(kind)
        rows = self._of_player(f"{kind}_daily", player_id, year).drop("year")
        return rows.join(self.t["game"].select("game_id", "visitor_team", "home_team"), "game_id").orderBy(F.asc_nulls_last("game_date"), "game_id").limit(limit)

    def player_games(self, player_id: str, year: int | None = None, limit: int = DEFAULT_ROWS) -> DataFrame:
        """Games that a player started, by date."""
        rows = self.t["lineup_start"].filter(F.col("player_id") == player_id).join(self.t["game"], "game_id")
        if year is not None:
            rows = rows.filter(F.year("game_date") == year)
        shown = rows.select("game_id", "game_date", "visitor_team", "home_team", "side", "batting_order", "fielding_position")
        return shown.orderBy(F.asc_nulls_last("game_date"), "game_id").limit(limit)


# --- filters ----------------------------------------------------------------

_OPERATORS = {
    "isNull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "equalTo": lambda c, v: c == v,
    "notEqualTo": lambda c, v: c != v,
    "distinctFrom": lambda c, v: ~c.eqNullSafe(v),
    "notDistinctFrom": lambda c, v: c.eqNullSafe(v),
    "in": lambda c, v: c.isin(list(v)),
    "notIn": lambda c, v: ~c.isin(list(v)),
    "lessThan": lambda c, v: c < v,
    "lessThanOrEqualTo": lambda c, v: c <= v,
    "greaterThan": lambda c, v: c > v,
    "greaterThanOrEqualTo": lambda c, v: c >= v,
    "includes": lambda c, v: F.contains(c, F.lit(v)),
    "includesInsensitive": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
    "startsWith": lambda c, v: F.startswith(c, F.lit(v)),
    "startsWithInsensitive": lambda c, v: F.startswith(F.lower(c), F.lit(v.lower())),
    "endsWith": lambda c, v: F.endswith(c, F.lit(v)),
    "like": lambda c, v: c.like(v),
    "notLike": lambda c, v: ~c.like(v),
    "likeInsensitive": lambda c, v: F.ilike(c, F.lit(v)),
}


def where(spec: Mapping[str, Any]) -> Column:
    """A filter as one Column: ``{column: {operator: value}}``, all of which hold, with ``and``, ``or`` and ``not``."""
    parts = [F.lit(True)]
    for key, value in spec.items():
        if key in ("and", "or"):
            inner = [where(v) for v in value]
            out = inner[0] if inner else F.lit(key == "and")
            for c in inner[1:]:
                out = (out & c) if key == "and" else (out | c)
            parts.append(out)
        elif key == "not":
            parts.append(~where(value))
        else:
            for op, v in value.items():
                if op not in _OPERATORS:
                    raise ValueError(f"unknown operator {op}")
                parts.append(_OPERATORS[op](F.col(key), v))
    out = parts[0]
    for c in parts[1:]:
        out = out & c
    return out


def _beyond(order_by: Sequence[str], row: Mapping[str, Any], forward: bool) -> Column:
    """Whether a row comes behind the given one in the order, or before it. Nulls are last ascending, first descending."""
    behind, level = F.lit(False), F.lit(True)
    for c in order_by:
        name, down = c.lstrip("-"), c.startswith("-")
        column, value = F.col(name), row[name]
        greater = down != forward  # whether the values looked for are greater; null is the greatest
        if value is None:
            further = F.lit(False) if greater else column.isNotNull()
        else:
            further = (column > value) | column.isNull() if greater else column < value
        behind, level = behind | (level & further), level & column.eqNullSafe(value)
    return behind


def connection(
    df: DataFrame, filter: Mapping[str, Any] | None = None, condition: Mapping[str, Any] | None = None, order_by: Sequence[str] = (),
    first: int | None = None, offset: int = 0, after: Mapping[str, Any] | None = None, last: int | None = None, before: Mapping[str, Any] | None = None,
    total: bool = False,
) -> DataFrame | Page:
    """Rows of a table by filter, equality ``condition`` on lookup columns and order (``-name`` for descending).

    ``first`` and ``offset`` cut a page from the front, ``last`` one from the end, in the same order. ``after`` starts behind
    a row given by its values of the order's columns and ``before`` ends before one: unlike an offset, they cost no rows
    that are skipped. Nulls come last ascending and first descending. With ``total`` the page is read at once, with the
    number of rows of all pages and whether there are rows on either side of it.
    """
    for name in [*(condition or {}), *(c.lstrip("-") for c in order_by)]:
        if name not in LOOKUPS and not name.endswith(("_id", "_date", "_seq")):
            raise ValueError(f"{name} isn't a lookup column")
    if last is not None and (first is not None or offset or not order_by):
        raise ValueError("last needs an order, and no first or offset")
    if filter:
        df = df.filter(where(filter))
    for name, value in (condition or {}).items():
        df = df.filter(F.col(name).eqNullSafe(value))
    order = [F.desc_nulls_first(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order_by]
    back = [F.asc_nulls_last(c[1:]) if c.startswith("-") else F.desc_nulls_first(c) for c in order_by]

    def cut(rows: DataFrame, more: int = 0) -> DataFrame:
        if after:
            rows = rows.filter(_beyond(order_by, after, True))
        if before:
            rows = rows.filter(_beyond(order_by, before, False))
        if last is not None:
            return rows.orderBy(*back).limit(last + more)
        rows = rows.orderBy(*order) if order else rows
        rows = rows.offset(offset) if offset else rows
        return rows if first is None else rows.limit(first + more)

    if not total:
        return cut(df).orderBy(*order) if last is not None else cut(df)
    rows, n = _counted(df, lambda seen: cut(seen, 1), bool(order))
    size = first if last is None else last
    cut_off = size is not None and len(rows) > size
    rows = rows[:size][::-1] if last is not None else rows[:size]
    return Page(rows, n, cut_off if last is None else bool(before), cut_off if last is not None else bool(after) or offset > 0)


@dataclass
class Page:
    """Rows of one page, the number of rows of all pages, and whether there may be rows behind it and before it: exactly told
    on the side that it is cut from; on the other true if a row or an offset was given."""

    rows: list[dict]
    total: int
    has_next: bool
    has_previous: bool


def related(tables: Mapping[str, DataFrame], child: str, column: str = "game_id", parent_rows: DataFrame | None = None, parents: bool = False) -> DataFrame:
    """Along a declared relation: the children of some parent rows, or, with ``parents``, each child with its parent's columns."""
    parent, key = RELATIONS[child, column]
    rows = tables[parent] if parent_rows is None else parent_rows
    if not parents:
        keys = rows.select(F.col(key).alias(column))
        return tables[child].join(keys, column, "left_semi")
    shown = rows.select(F.col(key).alias(column), *[F.col(c).alias(f"{parent}_{c}") for c in rows.columns if c != key])
    return tables[child].join(shown, column, "left")


def first_games(games: DataFrame, team: str, n: int) -> DataFrame:
    """Running wins and losses of a team over the first ``n`` games of each season, from rows (season, game_date,
    game_number, team, won, lost); a tie counts as neither."""
    order = Window.partitionBy("season", "team").orderBy("game_date", "game_number")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    own = games.filter(F.col("team") == team).withColumn("game_of_season", F.row_number().over(order)).filter(F.col("game_of_season") <= n)
    return own.withColumns({"wins": F.sum(F.col("won").cast("int")).over(upto), "losses": F.sum(F.col("lost").cast("int")).over(upto)})
