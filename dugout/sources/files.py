"""Readers of the source files: reference CSVs, rosters, schedules, game logs, event files and link lists.

A source tree has ``reference/*.csv``, ``seasons/<year>/`` with rosters, a schedule and event files, and
``gamelog/*.txt``. Columns go by position; missing trailing cells and blank cells are null; malformed numbers
and dates are null, never errors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.functions.columns import bool_or_null, compact_date, id_or_null, int_or_null, slash_date, text_or_null, us_date
from dugout.schemas import TABLES

_FILE = "_metadata.file_path"
_LINE = "_line"


def read_rows(spark: SparkSession, path: str | list[str], width: int, header: bool = False) -> DataFrame:
    """Cells c0, c1 ... as text: ragged rows, quoted line ends, doubled quotes and a byte-order mark are all right."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    return spark.read.csv(path, schema=schema, header=header, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)


def read_headed(spark: SparkSession, path: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of a CSV file by the names in its first line, as text; blank lines are left out and empty cells are empty text.
    ``keep`` names the columns wanted, in order; one that the file lacks is empty text."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return project_csv(rows, rows.columns if keep is None else keep)


def _typed(rows: DataFrame, schema: T.StructType, date=us_date) -> DataFrame:
    """Cells by position, as the schema's types."""
    coerce = {"date": date, "int": int_or_null, "string": lambda c: F.nullif(F.col(c), F.lit(""))}
    return rows.select(*[coerce[f.dataType.simpleString()](f"c{i}").alias(f.name) for i, f in enumerate(schema.fields)])


#: The tables that are one CSV file with a header row.
REFERENCE_FILES = {
    "people": "biofile.csv", "teams": "teams.csv", "ballparks": "ballparks.csv", "coaches": "coaches.csv",
    "ejections": "ejections.csv", "relatives": "relatives.csv",
}


def read_reference(spark: SparkSession, root: str, table: str) -> DataFrame:
    schema = TABLES[table]
    return _typed(read_rows(spark, f"{root}/reference/{REFERENCE_FILES[table]}", len(schema), header=True), schema)


def read_rosters(spark: SparkSession, root: str) -> DataFrame:
    """All rosters; the year is the folder's, fields are trimmed, rows without a player are left out."""
    rows = read_rows(spark, f"{root}/seasons/[0-9][0-9][0-9][0-9]/*.[rR][oO][sS]", 7)
    year = F.regexp_extract(F.col(_FILE), r"seasons/(\d{4})/", 1).cast("int")
    cells = {"player_id": 0, "last_name": 1, "first_name": 2, "bats": 3, "throws": 4, "team": 5, "position": 6}
    named = rows.select(year.alias("year"), *[text_or_null(f"c{i}").alias(n) for n, i in cells.items()])
    return named.filter("player_id is not null").select(*TABLES["roster"].names)


def read_schedules(spark: SparkSession, root: str) -> DataFrame:
    """All schedules. Rows that don't begin with a date, such as headers, are left out."""
    rows = read_rows(spark, f"{root}/seasons/[0-9][0-9][0-9][0-9]/[0-9][0-9][0-9][0-9]schedule.csv", 13)
    return _typed(rows, TABLES["schedule"], compact_date).filter("game_date is not null")


#: The fields of a game-log line, by position.
LOG_FIELDS = {
    "visitor_team": 3, "visitor_score": 9, "home_score": 10, "park_id": 16, "attendance": 17, "time_of_game_min": 18,
    "visitor_manager_id": 89, "visitor_manager_name": 90, "home_manager_id": 91, "home_manager_name": 92,
    "winning_pitcher_id": 93, "losing_pitcher_id": 95, "save_pitcher_id": 97, "visitor_starter_id": 101, "home_starter_id": 103,
}
LEAST_LOG_FIELDS = 93


def read_game_logs(spark: SparkSession, root: str) -> DataFrame:
    """One row per game of all game logs: of a game in several lines, the first by file, then place, counts."""
    lines = spark.read.text(f"{root}/gamelog/*.[tT][xX][tT]").select(F.trim("value").alias("value"), F.col(_FILE).alias("file"), F.monotonically_increasing_id().alias("place"))
    cells = F.transform(F.split("value", ","), lambda c: F.regexp_replace(c, '^"(.*)"$', "$1"))
    rows = lines.filter("value <> ''").select("file", "place", cells.alias("f")).filter(F.size("f") >= LEAST_LOG_FIELDS)
    cell = lambda i: F.get("f", F.lit(i))
    date, number, home = F.trim(cell(0)), F.trim(cell(1)), F.trim(cell(6))
    typed: dict[str, Column] = {
        "game_id": F.concat(home, date, number), "game_date": compact_date(date), "game_number": int_or_null(number).cast("short"), "home_team": home
    }
    for name, i in LOG_FIELDS.items():
        kind = TABLES["game_log"][name].dataType
        is_id = name.endswith("_id")
        typed[name] = int_or_null(cell(i)).cast(kind) if kind != T.StringType() else (id_or_null if is_id else text_or_null)(cell(i))
    rows = rows.filter((date != "") & (home != "")).select("file", "place", *[c.alias(n) for n, c in typed.items()])
    first = F.row_number().over(Window.partitionBy("game_id").orderBy("file", "place"))
    return rows.withColumn("_n", first).filter("_n = 1").select(*TABLES["game_log"].names)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """A list of dates and box-score links, tab-separated: logged_date, url and the game_id that the link names, null
    if it names none. Repeated games are kept once, the first by file order."""
    rows = spark.read.csv(path, sep="\t", schema="logged string, url string").withColumn("place", F.monotonically_increasing_id())
    pattern = r"boxesetc/\d{4}/B(\d{2})(\d{2})(\d)([A-Z]{3})(\d{4})\.htm"
    part = lambda i: F.regexp_extract("url", pattern, i)
    game = F.when(F.col("url").rlike(pattern), F.concat(part(4), part(5), part(1), part(2), part(3)))
    rows = rows.select("place", F.try_to_date(F.trim("logged"), F.lit("yyyy-MM-dd")).alias("logged_date"), "url", game.alias("game_id"))
    first = F.row_number().over(Window.partitionBy("game_id").orderBy("place"))
    return rows.withColumn("_n", F.when(F.col("game_id").isNotNull(), first).otherwise(1)).filter("_n = 1").drop("_n", "place")


def project_csv(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The named columns of a frame read with a header, in this order; one that is missing is empty text."""
    cell = lambda c: F.coalesce(F.col("`" + c.replace("`", "``") + "`"), F.lit(""))
    return rows.select(*[(cell(c) if c in rows.columns else F.lit("")).alias(c) for c in keep])


# --- event files ------------------------------------------------------------

ADJUSTMENTS = ("badj", "padj", "ladj", "radj", "presadj")
#: The info keys that become columns of ``game``, in its order, and those read as ids, numbers and flags.
INFO_KEYS = {
    "game_date": "date", "game_number": "number", "game_type": "gametype", "visitor_team": "visteam", "home_team": "hometeam",
    "site": "site", "start_time": "starttime", "day_night": "daynight", "innings": "innings", "tiebreaker": "tiebreaker",
    "use_dh": "usedh", "home_team_bats_first": "htbf", "pitches": "pitches", "ump_home": "umphome", "ump_1b": "ump1b",
    "ump_2b": "ump2b", "ump_3b": "ump3b", "ump_lf": "umplf", "ump_rf": "umprf", "field_cond": "fieldcond", "precip": "precip",
    "sky": "sky", "temp": "temp", "wind_dir": "winddir", "wind_speed": "windspeed", "time_of_game": "timeofgame",
    "attendance": "attendance", "winning_pitcher": "wp", "losing_pitcher": "lp", "save_pitcher": "save", "gwrbi": "gwrbi",
    "how_scored": "howscored", "official_scorer": "oscorer", "scorer": "scorer", "translator": "translator", "inputter": "inputter",
    "input_time": "inputtime", "edit_time": "edittime", "input_prog_vers": "inputprogvers",
}
_ID_COLUMNS = (
    "site", "ump_home", "ump_1b", "ump_2b", "ump_3b", "ump_lf", "ump_rf", "winning_pitcher", "losing_pitcher", "save_pitcher",
    "gwrbi", "official_scorer", "scorer", "translator", "inputter",
)


def csv_fields(line: Column) -> Column:
    """The fields of one line. One that begins with a quote goes on to the next single quote, commas included, or to the
    line's end if there is none; two quotes in it are one, and text behind it up to the comma belongs to it. So no line's
    fault reaches the next."""
    # with a comma behind it every field ends in one, but a quote that stays open takes the comma in
    one = r'\G(?:"(?:[^"]++|"")*+(?:"[^,]*+,|\z)|(?:[^,"][^,]*+)?,)'
    bodies = F.transform(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(one), F.lit(0)), lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
    within, behind = (lambda b, i=i: F.regexp_extract(b, r'(?s)^"((?:[^"]++|"")*+)"?(.*)$', i) for i in (1, 2))
    return F.transform(bodies, lambda b: F.when(b.startswith('"'), F.concat(F.replace(within(b), F.lit('""'), F.lit('"')), behind(b))).otherwise(b))


def read_records(spark: SparkSession, root: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """Records of all event files: game_id, seq (place behind the game's ``id`` line, blank lines not counted), type and
    fields f1 to f6. ``seasons`` prunes folders before anything is read."""
    years = "[0-9][0-9][0-9][0-9]" if seasons is None else "{" + ",".join(map(str, seasons)) + "}"
    files = spark.read.text(f"{root}/seasons/{years}/*.[eE][vV][nNaAeE]", wholetext=True).select(F.col(_FILE).alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n"))).filter("col <> ''")
    fields = lines.select("file", "pos", csv_fields(F.col("col")).alias("f"))
    parsed = fields.select("file", "pos", *[F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(f"f{i}") for i in range(7)])
    # one file has a season's games of one team: its lines fit a task, and files are dealt over all tasks
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parsed.withColumn("_game", F.sum(F.when(F.col("f0") == "id", 1).otherwise(0)).over(order))
    numbered = numbered.filter("_game > 0")
    within = Window.partitionBy("file", "_game").orderBy("pos")
    placed = numbered.withColumn("game_id", F.trim(F.first("f1").over(within))).withColumn("seq", F.row_number().over(within) - 1)
    return placed.filter("f0 <> 'id' and game_id <> ''").select("game_id", "seq", F.col("f0").alias("type"), *[f"f{i}" for i in range(1, 7)])


def game_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The tables that records fall into, and ``_plays``, the raw plays for the replay."""
    of = lambda *types: records.filter(F.col("type").isin(*types))
    number = lambda c: int_or_null(c).cast("short")
    or_zero = lambda c: F.coalesce(F.expr(f"try_cast(trim({c}) as int)"), F.lit(0))
    who = [F.trim("f1").alias("player_id"), F.coalesce("f2", F.lit("")).alias("player_name"), number("f3").alias("side"), number("f4").alias("batting_order"), number("f5").alias("fielding_position")]
    named = F.trim(F.coalesce("f1", F.lit(""))) != ""
    info = of("info").select("game_id", "seq", F.coalesce("f1", F.lit("")).alias("key"), F.col("f2").alias("value"))
    # of a key given twice the last value counts
    latest = info.groupBy("game_id").agg(*[F.max_by("value", F.when(F.col("key") == key, F.col("seq"))).alias(name) for name, key in INFO_KEYS.items()])
    games = records.select("game_id").distinct().join(latest, "game_id", "left")

    def typed(field: T.StructField) -> Column:
        c, kind = F.col(field.name), field.dataType
        if kind == T.DateType():
            return slash_date(c)
        if kind == T.BooleanType():
            return bool_or_null(c)
        if kind == T.IntegerType():
            return int_or_null(c)
        return id_or_null(c) if field.name in _ID_COLUMNS else c

    return {
        "game": games.select(*[(typed(f) if f.name != "game_id" else F.col("game_id")).alias(f.name) for f in TABLES["game"].fields]),
        "game_info": info.select("game_id", "key", "value"),
        "lineup_start": of("start").filter(named).select("game_id", *who),
        "substitution": of("sub").filter(named).select("game_id", "seq", *who),
        "comment": of("com").select("game_id", "seq", F.col("f1").alias("text")),
        "earned_runs": of("data").filter("f1 = 'er'").select("game_id", F.col("f2").alias("player_id"), int_or_null("f3").alias("earned_runs")),
        "game_adjustment": of(*ADJUSTMENTS).select("game_id", "seq", F.col("type").alias("adj_type"), F.col("f1").alias("field1"), F.col("f2").alias("field2")),
        "_plays": of("play").select(
            "game_id", "seq", or_zero("f1").alias("inning"), or_zero("f2").alias("half"), F.col("f3").alias("batter_id"),
            F.coalesce("f4", F.lit("")).alias("count"), F.col("f5").alias("pitches"), F.coalesce("f6", F.lit("")).alias("event"),
        ),
    }
