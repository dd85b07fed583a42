"""The replay as column expressions against a plain model, on random games; its queries against SQL."""

import random

import duckdb
import pytest

from dugout.functions.events import parse_events
from dugout.plans import scored
from dugout.plans.replay import lines_of, plays_of, replayed, timeline
from plain_replay import walk

SMALL = "/root/testdata/sf0.001"
ODD = ["", "NP", "99", "1-2", "SB2.1-H", "K+SB2", "K+PO1(13)", "W+WP.2-3", "POCS2(136)", "POCS3(1E6).2-3", "CSH(2)", "DI.1-2", "64(1)3/GDP", "54(2)/FO", "FC6.3XH(62);B-2;1-3", "S7.1XH(72);B-3", "PB.3-H", "C/E2", "HR.1-H;2-H;3-H", "E3/TH.B-2", "FLE3", "D8.1-H;1-3", "3E1.1-2", "S8.2XH(8E2)", "??", "K.BX1(23)"]


def games(n, seed):
    r = random.Random(seed)
    texts = ODD + [b[0] + m[0] + a[0] for b in scored.BASICS for m in scored.MODIFIERS for a in scored.ADVANCES]
    starts, subs, plays, moved = [], [], [], []
    for g in range(n):
        game, seq, inning, half = f"G{g}", 0, 1, 0
        for side in (0, 1):
            starts += [(game, f"p{side}{k}", side, k) for k in range(1, 11) if r.random() < 0.9]
        for _ in range(r.choice((1, 20, 60))):
            if r.random() < 0.2:
                inning, half = (inning + half, 1 - half) if r.random() < 0.9 else (inning, half)
                if r.random() < 0.5:
                    moved.append((game, seq, "radj", f"placed{seq}", str(r.choice((1, 2, 3, 7)))))
                    seq += 1
            if r.random() < 0.15:
                subs.append((game, f"s{r.randrange(6)}", r.choice((0, 1, None)), r.choice((1, 1, 2, 6, 9, 10, 11, None)), seq))
                seq += 1
            plays.append((game, seq, inning, half, f"b{half}{r.randrange(9)}", r.choice(("12", "??", None)), "X", r.choice(texts)))
            seq += 1
    return starts, subs, plays, moved


@pytest.mark.parametrize("strict", [False, True])
def test_random_games(spark, strict):
    starts, subs, plays, moved = games(40, 3 + strict)
    lineup = "game_id string, player_id string, side short, fielding_position short"
    frames = (
        spark.createDataFrame(starts, lineup), spark.createDataFrame(subs, lineup + ", seq int"),
        spark.createDataFrame(plays, "game_id string, seq int, inning int, half int, batter_id string, count string, pitches string, event string"),
        spark.createDataFrame(moved, "game_id string, seq int, adj_type string, field1 string, field2 string"),
    )
    events = timeline(*frames)
    by_game = {}
    for r in events.collect():
        by_game.setdefault(r["game_id"], []).append(r.asDict(recursive=True))
    wanted_plays, wanted_lines = [], []
    for game, rows in by_game.items():
        of, lines = walk(rows, strict)
        wanted_plays += [{"game_id": game, **p} for p in of]
        wanted_lines += [{"game_id": game, **line} for line in lines]
    replayed_rows = replayed(events, strict)
    for got, wanted in ((plays_of(replayed_rows), wanted_plays), (lines_of(replayed_rows), wanted_lines)):
        names = list(wanted[0])
        assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted((tuple(w[n] for n in names) for w in wanted), key=str)


def test_one_shuffle_in_the_jvm(spark):
    events = timeline(*scored.sources(spark, SMALL))
    before, after = (df._jdf.queryExecution().executedPlan().toString() for df in (events, replayed(events)))
    assert after.count("Exchange") == before.count("Exchange") + 1
    assert "Python" not in after and "Arrow" not in after


@pytest.mark.parametrize("name", ["event_parts", "replay_plays", "replay_lines", "pitcher_of_play"])  # the others are tested with what they are of
def test_queries(spark, name):
    got = scored.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({scored.SQL[name]})").fetchall()
    assert len(want) > 1000 and sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_no_games(spark):
    starts, subs, plays = (df.limit(0) for df in scored.sources(spark, SMALL))
    rows = replayed(timeline(starts, subs, plays))
    assert plays_of(rows).collect() == lines_of(rows).collect() == []
    assert parse_events(plays).collect() == []


def test_pitcher_as_of_is_the_replays(spark):
    asof = scored.QUERIES["pitcher_of_play"](spark, SMALL).collect()
    replay = plays_of(scored.replayed_games(spark, SMALL)).select("game_id", "play_seq", "pitcher_id").collect()
    assert sorted(map(tuple, asof), key=str) == sorted(map(tuple, replay), key=str) and any(r["pitcher_id"] is None for r in asof)
