"""Cuts outside parentheses and the fields of a line, against plain loops."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dugout.functions.events import once, parse_events, split_outside
from dugout.plans import derived, scored
from dugout.plans import scored
from dugout.sources.files import csv_fields

SMALL = "/root/testdata/sf0.001"


def cut(text, sign):
    pieces, depth = [""], 0
    for c in text:
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        if c == sign and not depth:
            pieces.append("")
        else:
            pieces[-1] += c
    return pieces


def fields(line):
    found, rest = [], line
    while True:
        value = ""
        if rest[:1] == '"':
            rest = rest[1:]
            while rest:
                if rest[:2] == '""':
                    value, rest = value + '"', rest[2:]
                elif rest[0] == '"':
                    rest = rest[1:]
                    break
                else:
                    value, rest = value + rest[0], rest[1:]
        behind, comma, rest = rest.partition(",")
        found.append(value + behind)
        if not comma:
            return found


def test_cuts(spark):
    r = random.Random(4)
    texts = ["", "a", ";", "a;b", "a(;)b;c", "(a(b;c);d);e", "a);b;c", "a(b;c", "((;);", "é;(ü;);\n;"] + ["".join(r.choice("ab;()") for _ in range(r.randint(1, 24))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_outside(F.col("t"), ";").alias("p"), split_outside(F.col("t"), ";", 2).alias("two"))
    for row in df.collect():
        want = cut(row["t"], ";")
        assert row["p"] == want
        assert row["two"] == (want if len(want) < 2 else [want[0], row["t"][len(want[0]) + 1 :]])


@pytest.mark.parametrize(
    "line, want",
    [
        ("info,visteam,SDN", ["info", "visteam", "SDN"]), ('com,"text, with comma"', ["com", "text, with comma"]), ('com,"He said ""hi"""', ["com", 'He said "hi"']),
        ("info,save,", ["info", "save", ""]), ('com,"open, to the end', ["com", "open, to the end"]), ('com,"open,', ["com", "open,"]), ('a,"b"c,d', ["a", "bc", "d"]),
        ('a,b"c",d', ["a", 'b"c"', "d"]), ('"",x', ["", "x"]), (",", ["", ""]), ('"""', ['"']), ('"a" "b",c', ['a "b"', "c"]),
    ],
)
def test_fields(spark, line, want):
    assert fields(line) == want == spark.range(1).select(csv_fields(F.lit(line))).first()[0]


def test_random_lines(spark):
    r = random.Random(8)
    lines = ["".join(r.choice('ab,"é ') for _ in range(r.randint(0, 20))) for _ in range(600)]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", csv_fields(F.col("x")).alias("f")).collect()
    assert all(row["f"] == fields(row["x"]) for row in got)


def test_nested_events(spark):
    got = scored.QUERIES["nested_events"](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({scored.SQL['nested_events']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    one = parse_events(spark.createDataFrame([("S8/L(7(8)9+2)/G6.1-2(E4(5;6)/TH);2-H",)], "event string")).first()
    assert [(p["basic"], p["modifiers"]) for p in one["plays"]] == [("S8", ["L(7(8)9+2)", "G6"])]
    assert [a["from"] + a["to"] for a in one["advances"]] == ["12", "2H"]


def test_each_distinct_event_is_parsed_once(spark):
    """Null and repeated events keep their rows; what is parsed are the distinct strings."""
    df = spark.createDataFrame([(1, "K"), (2, None), (3, "K"), (4, "S8.1-3"), (5, "K")], "n int, event string")
    parsed = []

    def parse(strings):
        parsed.append(strings.count())
        return parse_events(strings).select("event", "event_code")

    rows = once(df, parse).orderBy("n").collect()
    assert parsed == [3] and [(r["n"], r["event"], r["event_code"]) for r in rows] == [(1, "K", 3), (2, None, 0), (3, "K", 3), (4, "S8.1-3", 20), (5, "K", 3)]


def test_queries_parse_no_play_row_by_row(spark):
    d = "/root/testdata/sf0.001"
    for name, found in {"fielding_credits": derived.QUERIES, "start_log": derived.QUERIES, "replay_lines": scored.QUERIES, "audit_findings": scored.QUERIES}.items():
        plan = found[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan and "^SB" not in plan


def test_team_games_are_planned_once(spark):
    """The games behind regulars_rested come of the plays once, not anew for each total."""
    plan = derived.QUERIES["regulars_rested"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "scalar-subquery" not in plan
