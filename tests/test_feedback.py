"""Confidence that goes up from players to teams, events and leagues; places by country code."""

from pyspark.sql import functions as F

from linkloom.functions import geo
from linkloom.operators import state, teams


def test_players_raise_teams_and_events(spark):
    mapped = spark.createDataFrame([("L", "a", "x", 3, 0.8), ("L", "b", "y", 3, 0.95), ("L", "c", "z", 3, 0.5)], "league_id string, s string, t string, votes int, confidence double")
    matches = spark.createDataFrame([("L", "e1", "a", "b", True, 0.7), ("L", "e2", "c", "q", True, 0.9), ("L", "e3", "a", "b", False, 0.0)], "league_id string, event_id string, home_id string, away_id string, matched boolean, confidence double")
    overlap = spark.createDataFrame([("a", 0.7, 0.15), ("b", 0.5, 0.08)], "s string, overlap double, bonus double")
    better, events = teams.propagate(mapped, matches, overlap)
    assert {r["s"]: r["confidence"] for r in better.collect()} == {"a": 0.95, "b": 1.0, "c": 0.5}
    assert {r["event_id"]: r["confidence"] for r in events.collect()} == {"e1": 0.815, "e2": 0.9, "e3": 0.0}
    assert events.columns == matches.columns


def test_players_confirm_or_doubt_a_league(spark):
    players = spark.createDataFrame([(f"p{t}{i}", t) for t in "abcd" for i in range(5)], "id string, team_id string")
    hits = {"a": 5, "b": 2, "c": 1, "d": 0}
    matched = spark.createDataFrame([(t, f"p{t}{i}") for t, n in hits.items() for i in range(n)], "s string, player_id string")
    mapped = spark.createDataFrame([("up", "a"), ("same", "b"), ("down", "c"), ("hi", "d"), ("two", "a"), ("two", "d")], "league_id string, s string")
    rates = teams.league_player_rates(players, matched, mapped)
    assert {r["league_id"]: r["rate"] for r in rates.collect()} == {"up": 1.0, "same": 0.4, "down": 0.2, "hi": 0.0, "two": 0.5}
    leagues = spark.createDataFrame([(i, "c", 0.75, "LEAGUE_NAME_MED") for i in ("up", "same", "down", "none")] + [("hi", "c", 0.9, "LEAGUE_NAME_HI")], "id string, competition_id string, confidence double, rule string")
    got = {r["id"]: r["confidence"] for r in teams.feed_back(leagues, rates).collect()}
    assert got == {"up": 0.8, "same": 0.75, "down": 0.67, "none": 0.75, "hi": 0.9}


def test_levels(spark):
    rows = spark.createDataFrame([(0.65,), (0.45,), (0.3,), (0.1,)], "x double")
    assert [r[0] for r in rows.select(state.rcr_bonus(F.col("x"))).collect()] == [0.10, 0.05, 0.02, 0.0]
    assert [r[0] for r in rows.select(teams.league_feedback(F.lit(0.5), F.col("x"))).collect()] == [0.55, 0.5, 0.47, 0.42]


def test_location_score(spark):
    rows = [("England", "eng ", "England", "ENG"), ("England", "ENG", "England", "FRA"), ("Costa Rica", "", "Rica", "CRC"), (None, None, "England", None), ("", "", "", "")]
    df = spark.createDataFrame(rows, "a string, ca string, b string, cb string")
    got = [tuple(r["x"]) for r in df.select(geo.location_score(F.col("a"), F.col("ca"), F.col("b"), F.col("cb")).alias("x")).collect()]
    assert got == [(1.0, True), (0.1, False), (0.5, False), (0.0, False), (0.0, False)]
