"""Outs and fielding lines without a fold, against the fold on random games; what the audit plans."""

from dugout.plans import scored
from dugout.plans.replay import lines_from, lines_of, outs_of, plays_of, replayed, timeline
from test_replay import SMALL, games


def random_timeline(spark, seed):
    starts, subs, plays, moved = games(40, seed)
    lineup = "game_id string, player_id string, side short, fielding_position short"
    return timeline(
        spark.createDataFrame(starts, lineup), spark.createDataFrame(subs, lineup + ", seq int"),
        spark.createDataFrame(plays + [("odd", n, i, h, "b", None, "X", "K") for n, (i, h) in enumerate(((None, None), (None, None), (1, None), (1, 0), (None, None), (2, 1), (2, 1)))], "game_id string, seq int, inning int, half int, batter_id string, count string, pitches string, event string"),
        spark.createDataFrame(moved, "game_id string, seq int, adj_type string, field1 string, field2 string"),
    )


def alike(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_outs_are_the_replays(spark):
    """Half-innings that come again, plays without one, and blank plays included."""
    events = random_timeline(spark, 11)
    outs = outs_of(events)
    assert outs.count() > 500 and alike(outs, plays_of(replayed(events)).select("game_id", "play_seq", "event", "outs_before", "outs_on_play"))


def test_the_audit_folds_no_games(spark):
    for name in ("audit_shares", "audit_samples", "audit_findings"):
        plan = scored.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "aggregate(rows" not in plan and "collect_list" not in plan
        assert plan.count("Exchange hashpartitioning(game_id") <= 3  # of the same lines, so that one is run


def test_lines_are_the_replays(spark):
    """Vacant positions, the same player at several and plays of no half-inning included."""
    events = random_timeline(spark, 12)
    assert alike(lines_from(events), lines_of(replayed(events)))
    plan = scored.QUERIES["replay_lines"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(rows" not in plan and "collect_list" not in plan
