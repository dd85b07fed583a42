"""The event grammar and the replay, on hand-written events."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from dugout.functions.events import derived_runs, parse_events
from dugout.functions.fielding import credits
from dugout.plans.replay import lines_of, plays_of, replay, replayed, timeline

# event: expected fields of the parsed play
EVENTS = {
    "S8": dict(event_code=20, hit_value=1, at_bat=True, batter_reached=True, outs_on_play=0, fielding={}),
    "S8/L78.3-H": dict(hit_value=1, rbi=1, outs_on_play=0),
    "D7/L7LD": dict(event_code=21, hit_value=2),
    "DGR/L9": dict(event_code=21, hit_value=2),
    "T9": dict(event_code=22, hit_value=3),
    "HR/F9LD": dict(event_code=23, hit_value=4, rbi=1),
    "HR/F.1-H;2-H": dict(rbi=3),
    "HR9.B-H": dict(rbi=1, event_name="homeRun"),
    "K": dict(event_code=3, at_bat=True, outs_on_play=1, batter_reached=False, fielding={(2, "po"): 1}),
    "K+WP.B-1": dict(event_code=3, wild_pitch=True, batter_reached=True, outs_on_play=0),
    "K.BX1(23)": dict(event_code=3, batter_reached=False, outs_on_play=1, fielding={(2, "a"): 1, (3, "po"): 1}),
    "K+CS2(26)": dict(event_code=3, outs_on_play=2),
    "W": dict(event_code=14, at_bat=False),
    "IW": dict(event_code=15, at_bat=False),
    "I": dict(event_code=15),
    "HP": dict(event_code=16, at_bat=False),
    "63": dict(event_code=2, outs_on_play=1, batter_reached=False),
    "63/G6": dict(fielding={(6, "a"): 1, (3, "po"): 1}),
    "36(1)1/GDP/G3": dict(double_play=True, triple_play=False, outs_on_play=2),
    "5(2)/FO": dict(outs_on_play=1, double_play=False, batter_reached=True),
    "FC4/G4.1X3(456E5);B-2": dict(event_code=19, outs_on_play=0),
    "6(B)5(3)/LDP": dict(double_play=True, triple_play=False, outs_on_play=2),
    "8/SF.3-H": dict(sac_fly=True, at_bat=False, rbi=1, outs_on_play=1),
    "23/SH.1-2": dict(sac_hit=True, at_bat=False, outs_on_play=1),
    "SB2": dict(event_code=4, at_bat=False, outs_on_play=0),
    "CS2(26)": dict(event_code=6, outs_on_play=1, fielding={(2, "a"): 1, (6, "po"): 1}),
    "POCS2(236)": dict(event_code=8, outs_on_play=1),
    "WP.3-H": dict(event_code=9, wild_pitch=True, rbi=0),
    "8/F": dict(fielding={(8, "po"): 1}),
    "64(1)3/GDP": dict(fielding={(6, "a"): 1, (4, "po"): 1, (4, "a"): 1, (3, "po"): 1}),
    "E6": dict(event_code=18, fielding={(6, "e"): 1}),
    "PO1(13)": dict(event_code=8, fielding={(1, "a"): 1, (3, "po"): 1}),
    "S8.2X3(65)": dict(fielding={(6, "a"): 1, (5, "po"): 1}),
    "D7.2-H(E5)": dict(rbi=0, fielding={(5, "e"): 1}),
    "PB.2-3": dict(event_code=10, passed_ball=True, fielding={(2, "pb"): 1}),
    "C/E2.B-1": dict(event_code=17, at_bat=False, fielding={(2, "e"): 1, (2, "xi"): 1}),
    "FLE3/P3F": dict(event_code=13, at_bat=False, fielding={(3, "e"): 1}),
    "99": dict(event_code=2, outs_on_play=1, fielding={}),
    "!S8#?": dict(event_code=20),
    "BK.1-2": dict(event_code=11),
    "DI.1-2": dict(event_code=5),
    "OA.1-2": dict(event_code=12),
    "NP": dict(event_code=1, at_bat=False),
    "": dict(event_code=0, outs_on_play=0, rbi=0),
    "XYZ": dict(event_code=0),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = parse_events(spark.createDataFrame([(e,) for e in EVENTS], "event string")).withColumn("credits", credits()).collect()
    return {r["event"]: r for r in rows}


@pytest.mark.parametrize("event", EVENTS)
def test_event(parsed, event):
    row, want = parsed[event], dict(EVENTS[event])
    fielding = want.pop("fielding", None)
    assert {k: row[k] for k in want} == want
    if fielding is not None:
        got = Counter((c["position"], c["kind"]) for c in row["credits"])
        assert dict(got) == fielding


def test_advances(spark):
    row = parse_events(spark.createDataFrame([("S8/G6.3-H;2X3(64)(NR);??",)], "event string")).first()
    got = [(a["from"], a["to"], a["out"], a["params"]) for a in row["advances"]]
    assert got == [("3", "H", False, []), ("2", "3", True, ["64", "NR"])]
    row = parse_events(spark.createDataFrame([("K+PO1(13). 3-H ; 1-2;2-3;B-1",)], "event string")).first()
    assert [a["from"] + a["to"] for a in row["advances"]] == ["3H", "12", "23", "B1"]
    assert [p["basic"] for p in row["plays"]] == ["K", "PO1(13)"]


def test_null_event(spark):
    assert parse_events(spark.createDataFrame([(None,)], "event string")).first()["event_code"] == 0


@pytest.mark.parametrize(
    "event, runs",
    [("HR/F.1-H;2-H", 3), ("SBH;SB2", 1), ("SBH;SB2.3-H(UR)", 1), ("S9/L9M.3-H;2-H(UR);1-3", 2), ("64(1)/FO", 0), ("H/L7D.1-H", 2), ("HP.3-H;2-3;1-2", 1)],
)
def test_derived_runs(spark, event, runs):
    assert spark.range(1).select(derived_runs(F.lit(event))).first()[0] == runs


def run(spark, events, strict=False, starts=(), adjustments=(), inning=1):
    plays = [("G", i + 2, inning, 0, f"bat{i:02}", "00", "", e) for i, e in enumerate(events)]
    plays = spark.createDataFrame(plays, "game_id string, seq int, inning int, half int, batter_id string, count string, pitches string, event string")
    lineup = "game_id string, player_id string, side short, fielding_position short"
    starts = spark.createDataFrame([("G", p, 1, n) for p, n in starts], lineup)
    subs = spark.createDataFrame([], lineup + ", seq int")
    moved = spark.createDataFrame(list(adjustments), "game_id string, seq int, adj_type string, field1 string, field2 string")
    table, fielding = replay(timeline(starts, subs, plays, moved), strict)
    return table.orderBy("play_seq").collect(), {(r["player_id"], r["position"]): r for r in fielding.collect()}


REPLAYS = [
    (["S8", "SB2"], dict(base1_before="bat00", run1_dest=2, batter_dest=0, outs_before=0)),
    (["S8", "SB2", "S8"], dict(base2_before="bat00", base1_before=None)),
    (["T9", "SBH"], dict(base3_before="bat00", run3_dest=4, runs_on_play=1, rbi=0)),
    (["S8", "S8", "SB3;SB2"], dict(base1_before="bat01", base2_before="bat00", run1_dest=2, run2_dest=3)),
    (["S8", "K+SB2"], dict(event_code=3, outs_on_play=1, run1_dest=2)),
    (["S8", "SB2.1-3(E2/TH)"], dict(run1_dest=3)),
    (["S8", "DI.1-2"], dict(event_code=5, run1_dest=2)),
    (["S8", "CS2(26)"], dict(run1_dest=0, outs_on_play=1)),
    (["S8", "CS2(26)", "S8"], dict(base1_before=None, outs_before=1)),
    (["S8", "CS2(2E6)"], dict(run1_dest=2, outs_on_play=0)),
    (["S8", "PO1(13)"], dict(run1_dest=0, outs_on_play=1)),
    (["S8", "POCS2(136)"], dict(base1_before="bat00", run1_dest=0, outs_on_play=1)),
    (["S8", "PO1(E1).1-2"], dict(run1_dest=2, outs_on_play=0)),
    (["W", "W", "W", "W"], dict(runs_on_play=1, run3_dest=4, run2_dest=3, run1_dest=2, batter_dest=1)),
    # compatible with the usual tables, if not with what happened on the field
    (["S8", "64(1)/FO", "S8"], dict(base2_before="bat00")),
    (["S8", "64(1)3/GDP", "S8"], dict(base1_before="bat00")),
    (["S8", "FC4/G4.1X3(456E5);B-2"], dict(run1_dest=0, outs_on_play=0)),
]
STRICT = [
    (["S8", "64(1)/FO", "S8"], dict(base2_before=None, base1_before="bat01")),
    (["S8", "64(1)3/GDP", "S8"], dict(base1_before=None, base2_before=None, base3_before=None)),
    (["S8", "FC4/G4.1X3(456E5);B-2"], dict(run1_dest=3)),
]


@pytest.mark.parametrize("events, want, strict", [(*r, False) for r in REPLAYS] + [(*r, True) for r in STRICT])
def test_replay(spark, events, want, strict):
    last = run(spark, events, strict)[0][-1]
    assert {k: last[k] for k in want} == want


def test_placed_runner(spark):
    moved = [("G", 1, "radj", "x", "2")]
    assert run(spark, ["S8.2-H"], adjustments=moved, inning=10)[0][0]["runs_on_play"] == 0
    assert run(spark, ["S8.2-H"], strict=True, adjustments=moved, inning=10)[0][0]["runs_on_play"] == 1


def test_fielding_lines(spark):
    rows, lines = run(spark, ["63/G6", "NP", "K"], starts=[(f"h{n}", n) for n in range(1, 10)])
    assert [r["play_seq"] for r in rows] == [0, 1] and rows[0]["pitcher_id"] == "h1"
    assert (lines["h6", 6]["a"], lines["h6", 6]["games_started"], lines["h3", 3]["po"], lines["h2", 2]["po"]) == (1, True, 1, 1)
    assert lines["h8", 8]["outs"] == 2 and lines["h6", 6]["outs"] == 2


#: A game of two half-innings, and what a scorer would write down: outs, score and bases before, runs and ends of each play.
PLAYS = (
    ("S8", 0, 0, 0, None, None, None, 0, 1, 0, 0, 0), ("SB2", 0, 0, 0, "v0", None, None, 0, 0, 2, 0, 0), ("W", 0, 0, 0, None, "v0", None, 0, 1, 0, 2, 0),
    ("D7.2-H;1-3", 0, 0, 0, "v2", "v0", None, 1, 2, 3, 4, 0), ("K", 0, 1, 0, None, "v3", "v2", 0, 0, 0, 2, 3), ("8/SF.3-H", 1, 1, 0, None, "v3", "v2", 1, 0, 0, 2, 4),
    ("63/G6", 2, 2, 0, None, "v3", None, 0, 0, 0, 2, 0), ("HR/F9", 0, 2, 0, None, None, None, 1, 4, 0, 0, 0), ("HP", 0, 2, 1, None, None, None, 0, 1, 0, 0, 0),
    ("CS2(26)", 0, 2, 1, "h8", None, None, 0, 0, 0, 0, 0), ("E6", 1, 2, 1, None, None, None, 0, 1, 0, 0, 0), ("T9.1-H", 1, 2, 1, "h10", None, None, 1, 3, 4, 0, 0),
)
_AT = ("event", "outs_before", "away_score_before", "home_score_before", "base1_before", "base2_before", "base3_before", "runs_on_play", "batter_dest", "run1_dest", "run2_dest", "run3_dest")
#: Fielding lines of that game: player, position, side, outs, putouts, assists, errors.
LINES = (("f2", 2, 0, 1, 0, 1, 0), ("f6", 6, 0, 1, 1, 0, 1), ("g2", 2, 1, 3, 1, 0, 0), ("g3", 3, 1, 3, 1, 0, 0), ("g6", 6, 1, 3, 0, 1, 0), ("g8", 8, 1, 3, 1, 0, 0))


def _rows(spark):
    plays = [("G", i, 1, int(i > 6), f"{'h' if i > 6 else 'v'}{i}", "00", "", p[0]) for i, p in enumerate(PLAYS)]
    plays = spark.createDataFrame(plays, "game_id string, seq int, inning int, half int, batter_id string, count string, pitches string, event string")
    lineup = "game_id string, player_id string, side short, fielding_position short"
    starts = spark.createDataFrame([("G", p, s, n) for p, n, s, *_ in LINES], lineup)
    return replayed(timeline(starts, spark.createDataFrame([], lineup + ", seq int"), plays))


def test_hand_scored_game(spark):
    rows = _rows(spark)
    assert [tuple(r) for r in plays_of(rows).orderBy("play_seq").select(*_AT).collect()] == list(PLAYS)
    got = lines_of(rows).select("player_id", "position", "side", "outs", "po", "a", "e")
    assert sorted(map(tuple, got.collect())) == sorted(LINES)
