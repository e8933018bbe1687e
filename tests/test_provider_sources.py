"""Snapshots as a data source, scans of an embedded database, and selections of leagues and events."""

import http.server
import json
import threading

import pytest

from linkloom.schema import assert_schema
from linkloom.sources import database, selections, snapshots


def document(*teams):
    """A document of one fixture for each (team, [(player, name)])."""
    return {"Body": {"Fixtures": [{"Participants": [{"Id": t, "Name": f"T{t}", "Players": [{"Id": i, "Name": n} for i, n in players]}]} for t, players in teams]}}


@pytest.fixture
def folder(tmp_path):
    files = tmp_path / "snapshots"
    (files / "later").mkdir(parents=True)
    (files / "a.json").write_text(json.dumps(document((1, [(7, "Ada"), (8, "Bo"), (0, "None"), (9, "")]), (2, [(7, "Cy")]))))
    (files / "later" / "b.json").write_text(json.dumps(document((1, [(7, "Ada Again"), (5, "Di")]), (3, [(6, "Ed")]))))
    (files / "c.json").write_text(json.dumps({"Body": {"Fixtures": [{"Participants": None}, {}]}}))
    (files / "note.txt").write_text("no document")
    return files


def test_snapshots_are_read_in_parts(spark, folder):
    rows = snapshots.snapshots(spark, path=str(folder), bytes="1")
    assert rows.rdd.getNumPartitions() == 3
    got = {(r["team_id"], r["team_name"], r["id"], r["name"]) for r in rows.collect()}
    assert got == {("1", "T1", "7", "Ada"), ("1", "T1", "8", "Bo"), ("2", "T2", "7", "Cy"), ("1", "T1", "7", "Ada Again"), ("1", "T1", "5", "Di"), ("3", "T3", "6", "Ed")}
    once = assert_schema(snapshots.players(rows), "players")
    assert {(r["team_id"], r["id"]): r["name"] for r in once.collect()} == {("1", "7"): "Ada", ("1", "8"): "Bo", ("2", "7"): "Cy", ("1", "5"): "Di", ("3", "6"): "Ed"}
    by_uri = snapshots.snapshots(spark, path=f"file://{folder}")
    assert by_uri.count() == 6 and by_uri.rdd.getNumPartitions() == 1


def test_filters_reach_the_snapshots(spark, folder):
    rows = snapshots.snapshots(spark, path=str(folder), bytes="1")
    assert {r["name"] for r in rows.filter("team_id IN ('2', '3')").collect()} == {"Cy", "Ed"}
    assert {r["id"] for r in rows.filter("team_id = '1' AND name LIKE 'A%' AND place > 0").collect()} == {"7"}
    assert rows.filter("team_id = '1' AND team_id = '2'").count() == 0 and rows.filter("team_id <> '1'").count() == 2
    one = rows.filter(rows.document == f"{folder}/a.json")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 3
    (folder / "broken.json").write_text("{")  # not opened where only another document is asked for
    assert snapshots.snapshots(spark, path=str(folder), bytes="1").filter(f"document = '{folder}/a.json'").count() == 3
    with pytest.raises(Exception, match="broken.json is no JSON document"):
        snapshots.snapshots(spark, path=str(folder)).collect()


def test_snapshots_that_are_called_for(spark):
    asked = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked.append((self.path, self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(document((1, [(7, "Ada")])) if self.path == "/a" else document((2, [(8, "Bo")]))).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        rows = snapshots.snapshots(spark, urls=f"{at}/a, {at}/b", body='{"PackageId": 1}')
        assert {(r["document"], r["team_id"], r["name"]) for r in rows.collect()} == {(f"{at}/a", "1", "Ada"), (f"{at}/b", "2", "Bo")}
    finally:
        server.shutdown()
    assert sorted(asked) == [("/a", b'{"PackageId": 1}'), ("/b", b'{"PackageId": 1}')]


def test_players_by_table_first(spark, folder):
    rows = snapshots.snapshots(spark, path=str(folder))
    teams = spark.createDataFrame([(1,), (3,), (3,), (4,), (None,)], "team_id int")
    got = lambda table, whole=False: {(r["team_id"], r["id"], r["name"]) for r in snapshots.players_of_teams(spark, teams, table, rows, whole).collect()}
    saved = {("1", "7", "Ada"), ("1", "8", "Bo"), ("1", "5", "Di"), ("3", "6", "Ed")}
    assert got("no_such_table") == saved
    spark.createDataFrame([(70, "Al", 1), (None, "Nobody", 3), (71, "", 3), (72, "Other", 2)], "player_id int, name string, competitor_id int").createOrReplaceTempView("kept_players")
    assert got("kept_players") == {("1", "70", "Al"), ("3", "6", "Ed")}
    assert got("kept_players", whole=True) == {("1", "70", "Al")}
    spark.table("kept_players").filter("competitor_id = 2").createOrReplaceTempView("others")
    assert got("others", whole=True) == saved and got("others") == saved
    for name in ("kept_players", "others"):
        spark.catalog.dropTempView(name)


URL = "jdbc:derby:memory:linkloom;create=true"
DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(i, f"k'{i}", f"n{i % 5}") for i in range(1000)] + [(None, "none", "n")]
    frame = spark.createDataFrame(rows, "num int, code string, name string")
    frame.write.format("jdbc").options(url=URL, dbtable="things", createTableColumnTypes="code varchar(40), name varchar(40)", **DRIVER).mode("overwrite").save()
    frame.limit(0).write.format("jdbc").options(url=URL, dbtable="nothing", **DRIVER).mode("overwrite").save()
    return {(r[0], r[1], r[2]) for r in rows}


def test_scans_by_ranges(spark, stored):
    rows = database.scan(spark, URL, "things", "num", rows_a_task=300, **DRIVER)
    assert rows.rdd.getNumPartitions() == 4 and {tuple(r) for r in rows.collect()} == stored
    sizes = rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(sizes) <= 260
    plan = rows.filter("num > 990").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan" in plan and "code" not in plan.split("ReadSchema")[1]
    assert database.scan(spark, URL, "nothing", "num", **DRIVER).collect() == []
    with pytest.raises(TypeError, match="ranges need"):
        database.scan(spark, URL, "things", "code", **DRIVER)
    with pytest.raises(KeyError):
        database.scan(spark, URL, "things", "other", **DRIVER)


def test_lookups_by_batches_of_keys(spark, stored):
    keys = [f"k'{i}" for i in range(0, 1200, 3)]
    frame = spark.createDataFrame([(k,) for k in keys + keys[:9] + [None]], "key string")
    want = {r for r in stored if r[1] in set(keys)}
    got = database.lookup(spark, URL, "things", "code", frame, size=50, **DRIVER)
    assert got.rdd.getNumPartitions() == 8
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    joined = database.lookup(spark, URL, "things", "code", frame, range_column="num", most=10, **DRIVER)
    assert sorted(tuple(r) for r in joined.collect()) == sorted(want)
    assert database.lookup(spark, URL, "things", "code", frame.limit(0), **DRIVER).count() == 0
    assert database.batches("c", [3, 1, 2, 3], 2) == ["c IN (1, 2)", "c IN (3)"]
    with pytest.raises(TypeError):
        database.literal(0.5)


def test_events_of_team_pairs(spark):
    rows = [(f"e{i}", "L", 100 - i, "a", "b") for i in range(7)] + [("x", "L", 1, "b", "a"), ("y", "M", 1, "a", "b"), ("z", "L", 1, "a", None)]
    events = spark.createDataFrame(rows, "id string, tournament_id string, start_unix bigint, home_id string, away_id string")
    wanted = spark.createDataFrame([("L", "a", "b"), ("L", "a", "b"), ("L", "a", None)], "tournament_id string, home_id string, away_id string")
    assert sorted(r["id"] for r in selections.events_of_pairs(events, wanted).collect()) == ["e2", "e3", "e4", "e5", "e6"]
    assert [r["id"] for r in selections.events_of_pairs(events, wanted, 1).collect()] == ["e6"]


def test_leagues_of_a_sport(spark):
    leagues = spark.createDataFrame([("1", "A", 6046, "c"), ("1", "A", 6046, "c"), ("2", "B", 6046, "d"), ("3", "C", 1, "c"), ("4", "D", 6046, None)], "tournament_id string, name string, sport_id int, category_id string")
    categories = spark.createDataFrame([("c", "Spain", "6046"), ("c", "Spain", "6046"), ("d", "Peru", "1")], "category_id string, name string, sport_id string")
    got = sorted(tuple(r) for r in selections.leagues_of_sport(leagues, categories, "6046").collect())
    assert got == [("1", "A", "Spain"), ("2", "B", ""), ("4", "D", "")]


def test_target_leagues(spark):
    leagues = spark.createDataFrame([(i, f"L{i}", "f" if i < 10 else "b", "c") for i in range(1, 13)] + [(1, "L1", "f", "c"), (20, None, "f", None)], "tournament_id int, name string, sport_id string, category_id string")
    categories = spark.createDataFrame([("c", "Spain"), ("c", "Spain")], "category_id string, name string")
    counts = {1: 3, 2: 5, 3: 5, 4: 1, 10: 2, 11: 4}
    rows = [(f"e{t}-{i}", str(t), "2026-01-01") for t, n in counts.items() for i in range(n)]
    rows += rows[:6] + [("old", "4", "2025-01-01"), ("none", None, "2026-01-01"), ("odd", "99", "2026-01-01")] + [(f"o{i}", "5", "2025-12-31") for i in range(50)]
    events = spark.createDataFrame(rows, "event_id string, tournament_id string, scheduled string")
    hot = spark.createDataFrame([("4", 0), ("6", 1), ("20", None), ("77", 0)], "tournament_id string, is_deleted int")
    mapped = spark.createDataFrame([("4",), ("7",), ("",), (None,)], "tournament_id string")
    got = selections.target_leagues(hot, mapped, leagues, categories, events, "2026", {"f": 2, "b": 1})
    assert sorted((int(r["tournament_id"]), r["name"], r["category_name"], r["is_hot"], r["has_mapping"], r["event_count"]) for r in got.collect()) == [
        (2, "L2", "Spain", False, False, 5), (3, "L3", "Spain", False, False, 5), (4, "L4", "Spain", True, True, 1), (7, "L7", "Spain", False, True, 0),
        (11, "L11", "Spain", False, False, 4), (20, "", "", True, False, 0),
    ]
    top = selections.top_leagues(leagues, events, "2026", {"f": 3, "b": 9})
    assert sorted((r["sport_id"], r["place"], r["tournament_id"]) for r in top.collect()) == [("b", 1, "11"), ("b", 2, "10"), ("f", 1, "2"), ("f", 2, "3"), ("f", 3, "1")]
