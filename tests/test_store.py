"""A small source tree, loaded end to end; the read tools, filters, studies and audits over it."""

import datetime

import pytest
from pyspark.sql import functions as F

from dugout.operators.relational import parity
from dugout.plans import audit, starters, studies, tools
from dugout.sources.files import read_headed
from dugout.sources.store import Store

VISITORS = [(f"v{k:03d}a001", k) for k in range(1, 10)]
STORES = []
HOME = [(f"h{k:03d}a001", k) for k in range(1, 10)]


def game(game_id, date, plays, extra=""):
    starts = [f'start,{p},"Name, {p}",{side},{k},{k}' for side, nine in ((0, VISITORS), (1, HOME)) for p, k in nine]
    info = [f"info,visteam,SDN\ninfo,hometeam,SFN\ninfo,date,{date}\ninfo,usedh,true\ninfo,wp,h001a001\ninfo,lp,(none)\ninfo,temp,61"]
    return "\n".join([f"id,{game_id}", "version,2", *info, *starts, *[f"play,{i},{h},{b},02,CFX,{e}" for i, h, b, e in plays], extra, "data,er,h001a001,2"]) + "\n"


def write(root, path, text, bom=False):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    rest = {"coaches": "x", "ejections": "x", "relatives": "x", "ballparks": "x"}
    for name in rest:
        write(root, f"reference/{name}.csv", "header\n")
    write(root, "reference/biofile.csv", "ID,LAST,FIRST,NICK\n" + "\n".join(f'{p},"Last {p}",First,"Nick ""{k}""",4/6/1990' + "," * 27 + ",HOF" for p, k in VISITORS + HOME) + "\n", bom=True)
    write(root, "reference/teams.csv", "T,L,C,N,F,L\nSDN,NL,San Diego,Padres,1969,\nSFN,NL,San Francisco,Giants,1958,x\n")
    write(root, "seasons/2024/SFN2024.ROS", "h001a001,Last,First,R,R,SFN,P\n\n,,,\n")
    write(root, "seasons/2024/2024schedule.csv", "Date,Num\n20240405,0,Fri,SDN,NL,8,SFN,NL,8,d,SFO03,,\n")
    slam = [(1, 0, "v001a001", e) for e in ("W", "W", "W", "HR/F.3-H;2-H;1-H", "63/G6", "K", "8/F")]
    reply = [(1, 1, "h001a001", e) for e in ("W", "W", "W", "HR/F.3-H;2-H;1-H", "W", "SB2", "S8.2-H", "K", "K", "K")]
    first = game("SFN202404050", "2024/04/05", slam + reply, 'com,"a comment, with comma"\nsub,v010a001,"A, B",0,0,1\nradj,volpa001,2')
    write(root, "seasons/2024/2024SFN.EVN", "\n" + first + game("SFN202404060", "2024/04/06", [(1, 0, "v001a001", "63/G6"), (1, 1, "h001a001", "63/G6")]))
    cells = lambda date, v, h: ",".join(
        {0: f'"{date}"', 1: '"0"', 3: '"SDN"', 6: '"SFN"', 9: str(v), 10: str(h), 89: '"v001a001"', 91: '"(none)"'}.get(i, "") for i in range(161)
    )
    write(root, "gamelog/gl2024.txt", "\n".join([cells(20240405, 4, 5), cells(20240406, 0, 0), cells(20240407, 4, 4), "short,line"]) + "\n")
    store = Store(spark, str(tmp_path_factory.mktemp("store")), buckets=4)
    assert store.current() is None
    counts = store.load(str(root))
    assert counts["game"] == 2 and counts["play"] == 19 and counts["game_log"] == 3 and counts["roster"] == 1
    STORES.append((store, str(root), counts))
    return store.tables()


def test_sources(tables):
    g = tables["game"].filter("game_id = 'SFN202404050'").first()
    assert (g["game_date"], g["use_dh"], g["winning_pitcher"], g["losing_pitcher"], g["temp"]) == (datetime.date(2024, 4, 5), True, "h001a001", None, 61)
    assert tables["comment"].first()["text"] == "a comment, with comma"
    assert tables["people"].filter("player_id = 'v001a001'").first()["nickname"] == 'Nick "1"'
    assert tables["teams"].filter("team_id = 'SFN'").first()["last_year"] is None
    assert tables["game_adjustment"].count() == 1 and tables["schedule"].count() == 1


def test_daily_lines(tables):
    bat = {r["player_id"]: r for r in tables["batting_daily"].filter("game_id = 'SFN202404050'").collect()}
    assert (bat["v001a001"]["home_runs"], bat["v001a001"]["rbi"], bat["v001a001"]["walks"], bat["v001a001"]["runs"]) == (1, 4, 3, 4)
    assert bat["h001a001"]["stolen_bases"] == 1 and bat["h001a001"]["runs"] == 5
    pitch = {(r["game_id"], r["player_id"]): r for r in tables["pitching_daily"].collect()}
    line = pitch["SFN202404050", "h001a001"]
    assert (line["outs"], line["runs"], line["earned_runs"], line["won"], line["games_started"]) == (3, 4, 2, True, True)
    field = tables["fielding_daily"].filter("player_id = 'h006a001'").agg(F.sum("a").alias("a")).first()
    assert field["a"] == 2


def test_tools(spark, tables):
    t = tools.Tools(tables)
    assert t.search_people("LAST V00").count() == 9 and t.get_person("nobody") is None
    assert t.get_team("SFN")["city"] == "San Francisco" and t.get_roster("SFN", 2024).count() == 1
    assert [r["game_id"] for r in t.find_games(team="SFN", date_from="2024-04-06").collect()] == ["SFN202404060"]
    assert len(t.get_game("SFN202404050")["starters"]) == 18 and t.get_game("none") is None
    stats = t.player_stats("v001a001", 2024)
    assert stats["batting"].first()["hr"] == 1 and t.player_games("v001a001").count() == 2
    assert t.player_game_log("h001a001", "pitching").count() == 2
    with pytest.raises(ValueError):
        t.player_game_log("h001a001", "coaching")
    assert any(line.startswith("game(game_id string") for line in tools.describe_schema(tables))


@pytest.mark.parametrize("sql", ["DROP TABLE x", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT 1; SELECT 2", "SELECT 1) x; DROP VIEW t; --", "INSERT INTO t VALUES (1)"])
def test_sql_guard(spark, sql):
    with pytest.raises(Exception):  # noqa: B017
        tools.query_sql(spark, sql)


def test_sql(spark, tables):
    got = tools.query_sql(spark, "WITH a AS (SELECT * FROM play) SELECT count(*) AS n FROM a;", views={"play": tables["play"]})
    assert got.rows == [{"n": 19}] and not got.truncated
    many = tools.query_sql(spark, "SELECT id FROM range(500)", limit=7)
    assert many.returned == 7 and many.truncated


def test_connection(tables):
    rows = tools.connection(tables["people"], {"or": [{"player_id": {"startsWith": "v"}}, {"player_id": {"in": ["h001a001"]}}], "not": {"last_name": {"likeInsensitive": "%V009%"}}}, order_by=["-player_id"], first=3)
    assert [r["player_id"] for r in rows.collect()] == ["v008a001", "v007a001", "v006a001"]
    after = tools.connection(tables["people"], order_by=["player_id"], first=2, after={"player_id": "h002a001"})
    assert [r["player_id"] for r in after.collect()] == ["h003a001", "h004a001"]
    assert tools.related(tables, "comment", parent_rows=tables["game"].filter("game_id = 'SFN202404060'")).count() == 0


def test_lead_studies(tables):
    lost = studies.blown_leads(tables, 4).collect()
    assert [(r["game_id"], r["vis_blew"], r["home_blew"], r["lead"], r["peak_vis"], r["tie_home"], r["score_verified"]) for r in lost] == [("SFN202404050", True, False, 4, 4, 4, True)]
    assert lost[0]["visitor_name"] == "San Diego Padres"
    assert [r["game_id"] for r in studies.near_misses(tables, 5).collect()] == ["SFN202404050"]
    assert studies.lead_population(tables, (1, 4, 5)).first().asDict() == {"games": 2, "led_by_1": 1, "led_by_4": 1, "led_by_5": 0}
    assert studies.run_derivation_check(tables).first().asDict() == {"games": 2, "stored_match": 2, "derived_match": 2}
    assert studies.coverage(tables, 4).first()["without_plays"] == 1
    assert studies.coverage_by_decade(tables, 4).first()["decade"] == 2020
    assert studies.phantom_run_plays(tables).first()["plays"] == 0 == studies.dropped_run_plays(tables).first()["plays"]


def test_other_studies(spark, tables):
    day = datetime.date(2024, 4, 5)
    links = spark.createDataFrame([("SFN202404050", day), ("SFN202404060", day), ("none", day)], "game_id string, logged_date date")
    assert {r["game_id"] for r in studies.bad_links(tables, links).collect()} == {"SFN202404060", "none"}
    assert studies.first_sightings(tables, links).count() == 18
    assert [r["player_id"] for r in studies.first_managers(tables, links).collect()] == ["v001a001"]
    work = studies.workload_by_season(tables, "h001a001", 1).first()
    assert (work["gs"], work["w"], float(work["era"])) == (2, 2, 27.0)
    assert studies.workload_when_effective(tables, "h001a001", least_starts=1).first()["starts_good"] == 1
    split = studies.times_through_split(tables, "h001a001", 3, 1).first()
    assert (split["runs_first"], split["runs_after"]) == (0, 4)
    test = {r["venue"]: r for r in studies.support_test(tables, "SFN", "h001a001", 2024).collect()}
    assert test["TOTAL"]["starts"] == 2 == test["home"]["starts"]
    assert studies.runs_by_park(tables, 2024).first()["games"] == 2
    assert studies.support_by_starter(tables, "SFN", 2024, 1).first()["player_id"] == "h001a001"
    assert {r["league_rank"] for r in studies.offense_in_context(tables, "SFN", ["SFN", "SDN"], [2024]).collect()} == {1}


def test_audits(spark, tables):
    play = tables["play"]
    assert audit.grammar_audit(play).first()["outs_overflow"] == 0 and audit.unknown_events(play).count() == 0
    keys = ["game_id", "play_seq"]
    assert {r["share"] for r in parity(play, play, keys, ["rbi", "event_code"]).collect()} == {1.0}
    assert audit.mismatches(play, play.withColumn("rbi", F.lit(9)), keys, "rbi").count() == 15
    a = spark.createDataFrame([(1, "po", 3), (1, "po", 4), (2, "a", 6)], "k int, kind string, position int")
    b = spark.createDataFrame([(1, "po", 4), (1, "po", 3), (2, "a", 5)], "k int, kind string, position int")
    assert {r["kind"]: float(r["share"]) for r in audit.multiset_parity(a, b, ["k"]).collect()} == {"po": 1.0, "a": 0.0}


def test_joins_by_game_without_shuffles(spark, tables):
    store = STORES[0][0]
    for name in store.spark.catalog.listTables():  # as another session finds them: by the files alone
        if name.name.startswith("dugout_"):
            spark.sql(f"DROP TABLE {name.name}")
    t = store.tables()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = starters.bequeathed_runners(t, "h001a001", 2024)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.orderBy("game_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange hashpartitioning(game_id" not in plan and "Bucketed: true" in plan and "SortMergeJoin" in plan
    assert [r["game_id"] for r in rows] == ["SFN202404050", "SFN202404060"]


def test_seasons_prune_folders(tables):
    store = STORES[0][0]
    plan = lambda seasons: store.table("play", seasons)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan([2024]) or "PartitionFilters: [season" in plan([2024])
    assert store.table("play", [2024]).count() == 19 and store.table("play", [1999]).count() == 0
    assert store.tables([1999])["batting_daily"].count() == 0 < store.tables([2024])["batting_daily"].count()


def test_two_loads_one_kept(spark, tables, tmp_path):
    _, root, counts = STORES[0]
    store = Store(spark, str(tmp_path / "again"), buckets=2)
    assert store.load(root) == counts == {name: store.table(name).count() for name in counts}
    first = store.current()
    (tmp_path / "again" / "v1-b2-5").mkdir()  # what a load that failed leaves
    assert store.load(root, keep=1) == counts
    second = store.current()
    assert second != first and {p.name for p in (tmp_path / "again").iterdir()} == {"versions", second}
    assert not any((tmp_path / "again" / second / name).exists() for name in ("_records", "_replayed"))
    assert store.table("play").count() == counts["play"]


def test_reader_by_header(spark, tmp_path):
    (tmp_path / "rows.csv").write_text('EVENT_TX,OUTS,"A ""b"""\n"S8, x",1,\n\nK,,z\n')
    rows = [tuple(r) for r in read_headed(spark, str(tmp_path / "rows.csv")).collect()]
    assert rows == [("S8, x", "1", ""), ("K", "", "z")]
    assert [tuple(r) for r in read_headed(spark, str(tmp_path / "rows.csv"), ["OUTS", "gone", "EVENT_TX"]).collect()] == [("1", "", "S8, x"), ("", "", "K")]


def test_induction_order(spark):
    rows = spark.createDataFrame([("a", "Zed"), ("b", "Amy"), ("c", "Bob"), ("d", "Cy")], "player_id string, name string")
    got = studies.by_induction(rows, {"a": 1936, "c": 1990, "b": 1990}).collect()
    assert [(r["player_id"], r["inducted"]) for r in got] == [("a", 1936), ("b", 1990), ("c", 1990), ("d", None)]
