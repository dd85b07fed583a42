"""The store of derived tables: versioned folders of Parquet, and what is current.

A load writes all tables to a new folder and then appends its name to a small table of versions; readers take
the last one that is complete. So a failed load leaves what was there, and readers never see half of one. Tables
that queries join by game lie in the same number of buckets by game, sorted: their joins, windows and sums by game
need no shuffle. Large ones lie in a folder a season besides, so that a reader of some seasons opens those only.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dugout.plans.daily import batting_daily, fielding_daily, pitching_daily
from dugout.plans.replay import lines_of, plays_of, replayed, timeline
from dugout.schemas import TABLES, VERSION
from dugout.sources.files import REFERENCE_FILES, game_tables, read_game_logs, read_records, read_reference, read_rosters, read_schedules

_VERSIONS = "folder string, version int, applied_at timestamp"
#: Large tables lie in a folder for each season, so that a season's queries read that season only.
BY_SEASON = ("_records", "_replayed", "play", "batting_daily", "pitching_daily", "fielding_daily", "game_info", "lineup_start", "substitution")
#: Tables in buckets by game.
BY_GAME = ("play", "batting_daily", "pitching_daily", "fielding_daily", "game", "game_info", "lineup_start", "substitution", "earned_runs", "comment")
#: What only a load needs.
_PASSING = ("_records", "_replayed")


def list_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a source tree that don't come from its event files."""
    tables = {name: read_reference(spark, root, name) for name in REFERENCE_FILES}
    return tables | {"roster": read_rosters(spark, root), "schedule": read_schedules(spark, root), "game_log": read_game_logs(spark, root)}


class Store:
    """``buckets`` is the number that new loads use: about one for each core that is to work on a join."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def versions(self) -> DataFrame:
        return self.spark.read.schema(_VERSIONS).parquet(f"{self.path}/versions")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> str | None:
        """The folder of the last complete load under this library's schema version, or None."""
        system, path = self._path("versions")
        row = self.versions().orderBy(F.desc("applied_at")).first() if system.exists(path) else None
        return row["folder"] if row and row["version"] == VERSION else None

    def _named(self, folder: str, name: str) -> str:
        """The table's name in a session's catalog."""
        return re.sub(r"\W", "_", f"dugout_{zlib.crc32(self.path.encode()):08x}_{folder}_{name}")

    def _read(self, folder: str, name: str) -> DataFrame:
        if name not in BY_GAME:
            return self.spark.read.parquet(f"{self.path}/{folder}/{name}")
        table, buckets = self._named(folder, name), re.search(r"-b(\d+)-", folder)[1]
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name].fields)
            season, part = (", season int", "PARTITIONED BY (season)") if name in BY_SEASON else ("", "")
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}{season}) USING parquet {part} CLUSTERED BY (game_id) SORTED BY (game_id) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}/{name}'"
            )
            if part:
                self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return self.spark.table(table)

    def table(self, name: str, seasons: Sequence[int] | None = None) -> DataFrame:
        """A table of the current version; of one that lies by season, only the folders of ``seasons`` if they are given."""
        folder = self.current()
        if folder is None:
            raise LookupError(f"{self.path} holds no tables of schema version {VERSION}")
        df = self._read(folder, name)
        if seasons is not None and name in BY_SEASON:
            df = df.filter(F.col("season").isin(list(seasons)))
        return df.select(*TABLES[name].names) if name in TABLES else df

    def tables(self, seasons: Sequence[int] | None = None) -> dict[str, DataFrame]:
        return {name: self.table(name, seasons) for name in TABLES}

    def load(self, root: str, seasons: Sequence[int] | None = None, strict: bool = False, keep: int = 2) -> dict[str, int]:
        """Rebuild everything from a source tree, and make it current. Returns the number of rows of each table, counted as they
        are written. Of all versions the last ``keep`` stay; so a reader has the time of a load to be done with the one before."""
        folder = f"v{VERSION}-b{self.buckets}-{time.time_ns()}"
        written = lambda name: self._read(folder, name)
        counts: dict[str, int] = {}

        def write(df: DataFrame, name: str) -> None:
            counts[name] = self._write(df, folder, name)

        # event files are read once, and games replayed once: what several tables come from is written first
        write(read_records(self.spark, root, seasons), "_records")
        source = list_tables(self.spark, root) | game_tables(written("_records").drop("season"))
        raw = source.pop("_plays")
        for name, df in source.items():
            write(df, name)
        events = timeline(written("lineup_start").drop("season"), written("substitution").drop("season"), raw, written("game_adjustment"))
        write(replayed(events, strict), "_replayed")
        rows = written("_replayed")
        write(plays_of(rows), "play")
        play, game = written("play"), written("game")
        write(batting_daily(play, game), "batting_daily")
        write(pitching_daily(play, game, written("earned_runs"), written("lineup_start")), "pitching_daily")
        write(fielding_daily(lines_of(rows), game), "fielding_daily")
        self.spark.createDataFrame([(folder, VERSION)], "folder string, version int").withColumn("applied_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/versions")
        for name in _PASSING:
            self._delete(f"{folder}/{name}")
        self.prune(keep)
        return {name: counts[name] for name in TABLES}

    def prune(self, keep: int) -> list[str]:
        """Delete the folders of all versions but the last ``keep``, and those of loads that failed before these; their names."""
        known = [r["folder"] for r in self.versions().orderBy(F.desc("applied_at")).collect()]
        stay = known[: max(1, keep)]
        system, root = self._path("")
        found = [s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()]
        started = lambda folder: int(folder.rpartition("-")[2])
        gone = [f for f in found if re.fullmatch(r"v\d+-b\d+-\d+", f) and f not in stay and started(f) < started(stay[0])]
        for folder in gone:
            for name in BY_GAME:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._named(folder, name)}")
            self._delete(folder)
        return sorted(gone)

    def _delete(self, name: str) -> None:
        system, path = self._path(name)
        system.delete(path, True)

    def _write(self, df: DataFrame, folder: str, name: str) -> int:
        """Writes a table, and returns how many rows it has, from a metric that is observed on the way."""
        metric = Observation()
        rows = df.observe(metric, F.count(F.lit(1)).alias("n"))
        by_season, by_game = name in BY_SEASON, name in BY_GAME
        if by_season:
            rows = rows.withColumn("season", F.substring("game_id", 4, 4).try_cast("int"))
        if by_game:  # dealt as buckets are, so that each bucket of a season is one file
            rows = rows.repartition(self.buckets, "game_id")
        elif by_season:
            rows = rows.repartition("season", F.xxhash64("game_id") % 16)
        out = rows.write.partitionBy("season") if by_season else rows.write
        path = f"{self.path}/{folder}/{name}"
        if by_game:
            out.format("parquet").bucketBy(self.buckets, "game_id").sortBy("game_id").option("path", path).saveAsTable(self._named(folder, name))
        else:
            out.parquet(path)
        return metric.get["n"]
