"""Totals beside a cut, pages forward and backward against a sorted list, and the audit's queries."""

import duckdb
import pytest

from dugout.plans import audit, scored, tools

SMALL = "/root/testdata/sf0.001"
ROWS = [(f"g{i:02}", [None, "a", "b", "b"][i % 4], i) for i in range(23)]


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(ROWS, "game_id string, site string, n int").repartition(4)



@pytest.mark.parametrize("down", [False, True])
def test_pages_both_ways(games, down):
    """Ties on the first column, nulls at the end that the direction puts them to."""
    order = ["-site" if down else "site", "game_id"]
    want = sorted(ROWS, key=lambda r: r[0])
    want.sort(key=lambda r: (r[1] is None, r[1] or ""), reverse=down)
    row = lambda r: {"site": r[1], "game_id": r[0]}
    assert [r["game_id"] for r in tools.connection(games, order_by=order).collect()] == [r[0] for r in want]
    assert [r["game_id"] for r in tools.connection(games, order_by=order, last=4).collect()] == [r[0] for r in want[-4:]]
    for i in range(len(want)):
        behind = tools.connection(games, order_by=order, after=row(want[i]), first=3) if i % 5 == 0 else None
        if behind is not None:
            assert [r["game_id"] for r in behind.collect()] == [r[0] for r in want[i + 1 : i + 4]]
            ahead = tools.connection(games, order_by=order, before=row(want[i]), last=3)
            assert [r["game_id"] for r in ahead.collect()] == [r[0] for r in want[max(0, i - 3) : i]]
    between = tools.connection(games, order_by=order, after=row(want[2]), before=row(want[7]))
    assert [r["game_id"] for r in between.collect()] == [r[0] for r in want[3:7]]


def test_totals(games):
    page = tools.connection(games, {"n": {"lessThan": 20}}, order_by=["game_id"], first=5, after={"game_id": "g03"}, total=True)
    assert ([r["game_id"] for r in page.rows], page.total, page.has_next, page.has_previous) == ([f"g{i:02}" for i in range(4, 9)], 20, True, True)
    page = tools.connection(games, order_by=["game_id"], last=5, total=True)
    assert ([r["n"] for r in page.rows], page.total, page.has_next, page.has_previous) == ([18, 19, 20, 21, 22], 23, False, True)
    page = tools.connection(games, {"n": {"greaterThan": 99}}, first=5, total=True)
    assert (page.rows, page.total, page.has_next, page.has_previous) == ([], 0, False, False)
    page = tools.connection(games, condition={"site": None}, first=50, total=True)
    assert (len(page.rows), page.total, page.has_next) == (6, 6, False) and set(page.rows[0]) == {"game_id", "site", "n"}
    with pytest.raises(ValueError):
        tools.connection(games, last=3)


def test_query_counts(spark, games):
    got = tools.query_sql(spark, "SELECT id FROM range(0, 5000, 1, 7) ORDER BY id DESC", limit=3, count=True)
    assert (got.rows, got.truncated, got.total) == ([{"id": 4999}, {"id": 4998}, {"id": 4997}], True, 5000)
    got = tools.query_sql(spark, "WITH a AS (SELECT * FROM games WHERE n < 4) SELECT n FROM a ORDER BY n", views={"games": games}, count=True)
    assert ([r["n"] for r in got.rows], got.truncated, got.total) == ([0, 1, 2, 3], False, 4)
    games.limit(1).createOrReplaceTempView("games")  # a view of the user's own
    assert tools.query_sql(spark, "SELECT count(*) AS n FROM games", views={"games": games}).rows == [{"n": 23}]
    assert spark.table("games").count() == 1 and [t.name for t in spark.catalog.listTables() if t.name.startswith("view_")] == []
    spark.catalog.dropTempView("games")
    with pytest.raises(Exception):
        tools.query_sql(spark, "SELECT 1) UNION ALL (SELECT 2; DROP VIEW games")


@pytest.mark.parametrize("name", ["audit_findings", "audit_samples", "audit_shares"])
def test_audit_queries(spark, name):
    got = scored.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({scored.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_comment_right_behind(spark):
    rows = [("G", 0, "play", "??"), ("G", 1, "com", None), ("G", 2, "play", "S8.9-9"), ("G", 3, "sub", None), ("G", 4, "com", None), ("G", 5, "play", "NP"), ("G", 6, "play", "")]
    records = spark.createDataFrame([(g, s, k, "said" if k == "com" else None, e) for g, s, k, e in rows], "game_id string, seq int, type string, f1 string, f6 string")
    play = spark.createDataFrame([], "game_id string, play_seq int, event string, outs_before int, outs_on_play int")
    found = audit.findings(records, play)
    assert sorted((r["category"], r["seq"], r["detail"], r["comment"]) for r in found.collect()) == [("unknown_event", 0, "no known event", "said"), ("unparsed_advance", 2, "9-9", None)]
    assert [(r["category"], r["n"]) for r in audit.finding_counts(found, records).collect()] == [("unknown_event", 1), ("unparsed_advance", 1), ("outs_overflow", 0)]
