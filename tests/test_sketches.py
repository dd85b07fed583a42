"""Merged daily sketches against exact answers, within the errors stated."""

import datetime
import random

from pyspark.sql import functions as F

from dugout.operators import sketches
from dugout.plans import derived, derived_studies


def test_merged_days(spark):
    r = random.Random(6)
    day = datetime.date(2023, 12, 1)
    # one key holds nearly all rows; a day without values; repeated values within and between days
    rows = [("hot" if r.random() < 0.9 else "cold", day + datetime.timedelta(r.randrange(60)), f"p{int(r.paretovariate(0.3)) % 6000}", r.gauss(100, 20)) for _ in range(40_000)]
    rows += [("empty", day, None, None)]
    df = spark.createDataFrame(rows, "k string, d date, who string, x double").repartition(6)
    path = sketches.daily(df, ["k"], F.col("d"), {"players": F.col("who")}, {"pitches": F.col("x")})
    stored = spark.createDataFrame(path.collect(), path.schema)  # as read from a table
    got = sketches.merged(stored, ["k", F.year("day").alias("season")], ["players"], {"pitches": {"median": 0.5, "p90": 0.9}})
    assert got.columns == ["k", "season", "n", "players", "median", "p90"]
    for g in got.collect():
        mine = [x for x in rows if x[0] == g["k"] and x[1].year == g["season"]]
        who = {x[2] for x in mine} - {None}
        assert g["n"] == len(mine) and abs(g["players"] - len(who)) <= 4 * 0.016 * max(len(who), 1)
        values = sorted(x[3] for x in mine if x[3] is not None)
        for name, q in (("median", 0.5), ("p90", 0.9)):
            if not values:
                assert g[name] is None
            else:
                assert abs(sum(v <= g[name] for v in values) / len(values) - q) < 0.02


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, d date, who string, x double")
    stored = sketches.daily(none, ["k"], F.col("d"), {"players": F.col("who")}, {"pitches": F.col("x")})
    assert sketches.merged(stored, ["k"], ["players"], {"pitches": {"median": 0.5}}).collect() == []


def test_seasons(spark):
    small = "/root/testdata/sf0.001"
    t = derived.tables(spark, small)
    exact = t["batting_daily"].groupBy(F.year("game_date").alias("season")).agg(F.countDistinct("player_id").alias("players"), F.count("*").alias("n"))
    want = {r["season"]: (r["players"], r["n"]) for r in exact.collect()}
    got = {r["season"]: r for r in derived_studies.QUERIES["season_sketches"](spark, small).filter("kind = 'batters'").collect()}
    assert got.keys() == want.keys()
    for season, (players, n) in want.items():
        assert abs(got[season]["players"] - players) <= 4 * 0.016 * players and got[season]["n"] == n and got[season]["median_faced"] is None
