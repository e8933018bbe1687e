"""Whole runs, sources and reports on small tables."""

from pyspark.sql import functions as F

from linkloom import sources
from linkloom.operators import reports, state
from linkloom.plans import matching
from linkloom.schema import SCHEMAS, assert_schema, canonical

T0 = 1745496000


def inputs(spark):
    clubs = ["Arsenal", "Chelsea", "Everton", "Liverpool"]
    games = [(h, a) for h in clubs for a in clubs if h != a]
    row = lambda i, h, a, t, league, p: (f"{p}{i}", league, t, f"{p}{h}", h, f"{p}{a}", a, 1, p)
    s = [row(i, h, a, T0 + 86400 * i, "L1", "sr") for i, (h, a) in enumerate(games)]
    t = [row(i, h + " FC", a + " FC", T0 + 86400 * i + 900, "C1", "ts") for i, (h, a) in enumerate(games)]
    make = lambda rows, kind: spark.createDataFrame(rows, SCHEMAS[kind])
    return matching.Inputs(
        make([("L1", "Premier League", "football", "England", "sr"), ("L2", "E-Soccer League", "football", "England", "sr")], "tournaments"),
        make(s, "events"),
        make([("C1", "English Premier League", "football", "England", "ts"), ("C2", "FA Cup", "football", "England", "ts")], "tournaments"),
        make(t, "events"),
        spark.createDataFrame([("Premier League", ["English Premier League", "EPL"], 1)], "canonical string, aliases array<string>, group_seq int"),
    )


def test_run(spark):
    found = matching.run(inputs(spark))
    league = {r["id"]: (r["competition_id"], r["rule"]) for r in found.leagues.collect()}
    assert league["L1"] == ("C1", "LEAGUE_NAME_HI")
    stats = {r["league_id"]: r for r in found.stats.collect()}["L1"]
    assert stats["total"] == 12 and stats["n_matched"] == 12 and stats["rate"] == 1.0
    assert {(r["s"], r["t"]) for r in found.teams.collect()} == {(f"sr{c}", f"ts{c} FC") for c in ("Arsenal", "Chelsea", "Everton", "Liverpool")}
    assert found.rates.first()["rcr_documented"] == 1.0
    assert matching.learned_aliases(found, "football", 1).count() == 4


def test_bulk(spark):
    found = matching.bulk(inputs(spark))
    assert {r["id"] for r in found.leagues.collect()} == {"L1"}
    assert found.events.filter("matched").count() == 12


def test_sources(spark, tmp_path):
    leagues = spark.createDataFrame([("1", "Premier League", "sr:sport:1", "9"), ("2", "X", "zz", None)], "tournament_id string, name string, sport_id string, category_id string")
    cats = spark.createDataFrame([("9", "England"), ("9", "England")], "category_id string, name string")
    got = {r["id"]: (r["sport"], r["category_name"]) for r in assert_schema(sources.tournaments(leagues, cats, "sr"), "tournaments").collect()}
    assert got == {"1": ("football", "England"), "2": ("unknown", "")}
    raw = spark.createDataFrame([("e", "1", "2026-03-22T14:15:00+00:00", "a", "b", 1), ("e", "1", "2026-03-22T14:15:00+00:00", "a", "b", 1), ("f", "1", "bad", "a", "z", None)], "sport_event_id string, tournament_id string, scheduled string, home_competitor_id string, away_competitor_id string, status_code int")
    names = spark.createDataFrame([("a", "Arsenal"), ("b", "Barcelona")], "competitor_id string, name string")
    rows = {r["id"]: r for r in sources.events(raw, names, "sr").collect()}
    assert rows["e"]["start_unix"] == 1774188900 and rows["e"]["home_name"] == "Arsenal" and rows["f"]["away_name"] == "" and rows["f"]["start_unix"] == 0
    assert sources.team_names(sources.events(raw, names, "sr")).count() == 3
    people = spark.createDataFrame([("p", "Messi", "Lionel Messi", "1987-06-24", "ARG"), ("q", "Xavi", "Xavi", None, None)], "player_id string, name string, full_name string, date_of_birth string, nationality string")
    teams = spark.createDataFrame([("a", '["p", "q"]')], "competitor_id string, player_ids string")
    assert {r["id"]: r["name"] for r in sources.team_players(teams, people).collect()} == {"p": "Lionel Messi", "q": "Xavi"}
    (tmp_path / "snap.json").write_text('{"Body": {"Fixtures": [{"Participants": [{"Id": "1", "Name": "A", "Players": [{"Id": "7", "Name": "P"}, {"Id": "7", "Name": "P"}]}]}]}}')
    assert [(r["team_id"], r["id"]) for r in sources.snapshot_players(spark, str(tmp_path / "snap.json")).collect()] == [("1", "7")]
    registry = sources.Registry()
    registry.register(sources.Source("sr", {"teams": lambda s: canonical(s.createDataFrame([("1", "A", "sr")], SCHEMAS["teams"]), "teams")}))
    assert registry.load(spark, "sr", "teams").count() == 1 and registry.names() == ["sr"]


def test_reports_and_validation(spark):
    p = spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "a int, b int")
    t = spark.createDataFrame([(1, 1), (2, 2), (4, 4), (5, 5)], "a int, b int")
    r = reports.precision_recall(p, t, ["a", "b"]).first()
    assert (r["tp"], round(r["precision"], 3), r["recall"], round(r["f1"], 3)) == (2, 0.667, 0.5, 0.571)
    empty = reports.precision_recall(p.limit(0), t, ["a", "b"]).first()
    assert empty["precision"] == 0 and empty["f1"] == 0
    rows = spark.createDataFrame([("a", 9, 0.1), ("b", 9, 0.9), ("c", 2, 0.1), ("d", 9, 0.1)], "key string, n_events int, rcr double")
    over = spark.createDataFrame([("d",)], "key string")
    got = {x["key"]: (x["status"], x["confidence"]) for x in state.validate_known(rows, over).collect()}
    assert got == {"a": ("SUSPECT", 0.8), "b": ("OK", 1.0), "c": ("INSUFFICIENT", 1.0), "d": ("OVERRIDE", 1.0)}
    assert state.set_override(over, spark.createDataFrame([("d",)], "key string"), on=False).count() == 0
    log = spark.createDataFrame([("a", i, i, "OK" if i < 5 else "SUSPECT", i / 10) for i in range(6)] + [("a", 9, 9, "OVERRIDE", 1.0)], "key string, at int, seq int, status string, rcr double")
    x = state.recent_mean(log, 3).first()
    assert round(x["mean_rcr"], 3) == 0.4 and x["suspect"]
    totals = reports.with_totals(spark.createDataFrame([("x", 1), ("y", 2)], "league string, n bigint"), "league")
    assert {r["league"]: r["n"] for r in totals.collect()} == {"x": 1, "y": 2, "TOTAL": 3}
    marks = spark.createDataFrame([("g", "EVENT_L1"), ("g", "EVENT_NO_MATCH")], "g string, rule string")
    assert reports.rule_counts(marks, ["g"]).select(F.col("EVENT_L1")).first()[0] == 1
