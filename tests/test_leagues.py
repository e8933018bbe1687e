"""League features, vetoes, aliases and scores: literal cases; blocked candidates against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import features, league_index, leagues


def of(spark, names, field):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return [r["v"] for r in sorted(rows.select("i", features.league_features(F.col("n"))[field].alias("v")).collect(), key=lambda r: r["i"])]


def pair(spark, pairs, f):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = rows.withColumn("x", features.league_features(F.col("a"))).withColumn("y", features.league_features(F.col("b")))
    return [r["v"] for r in sorted(rows.select("i", f(F.col("x"), F.col("y")).alias("v")).collect(), key=lambda r: r["i"])]


def test_tiers(spark):
    want = {"Segunda Division Spain": 2, "Tercera Division": 3, "1st Division": 1, "2nd Division": 2, "3rd Division": 3, "Primera Division": 1, "Erste Liga": 1, "Zweite Liga": 2, "Dritte Liga": 3, "Terceira Liga": 3, "Liga 2": 2, "Division 3": 3, "Serie B": 2, "J2 League": 2, "Premier League": 0, "League II": 2}
    assert of(spark, list(want), "tier_number") == list(want.values())


def test_types(spark):
    reserve = ["Arsenal Reserves", "Chelsea B Team", "Manchester United II Team", "Segunda Equipa Porto"]
    assert of(spark, reserve, "comp_type") == ["reserve"] * 4
    regional = [f"Campeonato {x}" for x in ("Paulista", "Carioca", "Gaucho", "Mineiro", "Baiano")]
    assert of(spark, regional, "comp_type") == ["regional_league"] * 5
    assert of(spark, ["Premier League", "FA Cup", "Super Cup", "Feminin Cup"], "comp_type") == ["league", "cup", "super_cup", "short_format"]
    assert of(spark, ["Premier League U19", "Youth League", "x"], "age_group") == ["u19", "youth", ""]
    assert of(spark, ["North East League", "Northern League", "Northampton"], "region") == ["northeast", "north", ""]
    assert of(spark, ["Premier League Women", "Men League", "Mentor League"], "gender") == ["women", "men", ""]


def test_vetoes(spark):
    pairs = [("Premier League Women", "Premier League"), ("Arsenal Reserves", "Premier League"), ("Premier League", "Arsenal Reserves"), ("Campeonato Paulista", "Brasileiro Serie A"), ("Liga 2 Peru", "Liga 1 Peru"), ("FA Cup", "Premier League"), ("Premier League U19", "Premier League"), ("Premier League", "La Liga"), ("CBA Draft", "CBA")]
    got = pair(spark, pairs, features.league_veto)
    assert got[0] == "gender_conflict"
    assert got[1] == got[2] == "age_conflict"  # reserve words are youth words as well
    assert got[3:] == ["competition_type_conflict", "tier_number_conflict", "competition_type_conflict", "age_conflict", None, "competition_type_conflict"]


def test_penalty(spark):
    kinds = [("Equipe B", "Chelsea"), ("Paulista", "Sao Paulo"), ("Premier League", "La Liga")]
    assert pair(spark, kinds, features.feature_penalty) == [0.5, 0.7, 1.0]


GROUPS = [("EFL League One", ["League One", "Football League One", "English Football League One"], 1), ("MLS", ["Major League Soccer", "MLS USA"], 2), ("World Cup", ["FIFA World Cup", "Both"], 3), ("Other", ["Both"], 4)]


def index(spark):
    return leagues.alias_index(spark.createDataFrame(GROUPS, "canonical string, aliases array<string>, group_seq int"))


def test_alias_index(spark):
    found = {r["alias_norm"]: r["canonical"] for r in index(spark).collect()}
    assert found["league one"] == "EFL League One" and found["both"] == "Other" and "random name" not in found
    pairs = spark.createDataFrame([("League One", "EFL League One"), ("Serie A", "Ligue 1"), ("Same", "Same")], "a string, b string")
    score = {r["a"]: r["alias_score"] for r in leagues.alias_similarity(pairs, "a", "b", index(spark)).collect()}
    assert score["League One"] == 0.98 and score["Serie A"] < 0.90 and score["Same"] == 1.0


def test_scores(spark):
    cases = [("Premier League", "Premier League", "England", "England"), ("EFL League One", "League One", "England", "England"), ("MLS", "MLS USA", "USA", "United States"), ("Bundesliga", "Bundesliga", "Germany", "Germany"), ("Premier League U19", "Premier League U21", "England", "England"), ("Premier League Women", "Premier League", "England", "England"), ("Campeonato Paulista", "Brasileiro Serie A", "Brazil", "Brazil"), ("Liga 2 Peru", "Liga 1 Peru", "Peru", "Peru")]
    pairs = spark.createDataFrame(cases, "a string, b string, pa string, pb string")
    scored = leagues.alias_similarity(pairs, "a", "b", index(spark))
    got = {(r["a"], r["b"]): r["s"] for r in scored.select("a", "b", leagues.league_score(F.col("alias_score"), "a", "b", "pa", "pb").alias("s")).collect()}
    values = [got[c[:2]] for c in cases]
    assert all(v >= 0.55 for v in values[:4]) and all(v == 0 for v in values[4:])
    assert round(values[1], 3) == round(values[2], 3) == 0.984


def test_match_leagues(spark):
    rows = spark.createDataFrame([("sr:tournament:17", "Premier League", "football", "England", "sr"), ("2", "League One", "football", "England", "sr"), ("3", "Xyzzy", "football", "Peru", "sr")], "id string, name string, sport string, category_name string, source string")
    cands = spark.createDataFrame([("c1", "English Premier League", "football", "England", 1), ("c2", "EFL League One", "football", "England", 2)], "competition_id string, competition_name string, sport string, country string, candidate_seq int")
    known = spark.createDataFrame([("football", "sr:tournament:17", "kx")], "sport string, id string, competition_id string")
    got = {r["id"]: (r["competition_id"], r["rule"]) for r in leagues.match_leagues(rows, cands, index(spark), known).collect()}
    assert got["sr:tournament:17"] == ("kx", "LEAGUE_KNOWN") and got["2"] == ("c2", "LEAGUE_NAME_HI") and got["3"][1] == "LEAGUE_NO_MATCH"
    low = {r["id"]: r["rule"] for r in leagues.best_even_if_low(rows, cands, index(spark)).collect()}
    assert low["2"] == "LEAGUE_NAME_HI"


@pytest.mark.parametrize(("seed", "weights", "k", "least"), [(1, leagues.LS, 5, 0.0), (2, leagues.SR, 1, 0.0), (3, leagues.LS, 2, 0.4)])
def test_index_is_all_pairs(spark, monkeypatch, seed, weights, k, least):
    monkeypatch.setattr(league_index, "BLOCK", 15)
    monkeypatch.setattr(league_index, "FIRST", 1)
    rng = random.Random(seed)
    words = ["premier", "league", "liga", "serie", "cup", "women", "u19", "north", "copa", "division", "2", "1", "b", "super", "reserve", "paulista", "one", "mls", "draft", "beach"]
    places = ["England", "Spain", "Peru", "USA", "United States", "International", "World", None, "", "Germany"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4))).title()
    left = [(f"l{i}", name(), rng.choice(["football", "basketball"]), rng.choice(places)) for i in range(40)] + [("alone", "No Candidate", "curling", "")]
    right = [(f"c{i}", name(), rng.choice(["football", "basketball", "tennis"]), rng.choice(places), i) for i in range(50)]
    a = spark.createDataFrame(left, "id string, name string, sport string, category_name string")
    b = spark.createDataFrame(right, "competition_id string, competition_name string, sport string, country string, candidate_seq int")
    groups = [("Premier League", ["premier", "liga one", "mls"], 1), ("Copa", ["cup", "super cup"], 2)]
    known = leagues.alias_index(spark.createDataFrame(groups, "canonical string, aliases array<string>, group_seq int"))
    rows = lambda d: sorted((r["id"], r["rank"], r["competition_id"], r["league_name"], r["country"], round(r["score"], 9)) for r in d.collect())
    got = rows(leagues.ranked_candidates(a, b, known, weights, least, k))
    assert got == rows(leagues.all_candidates(a, b, known, weights, least, k))
    assert got


def test_no_join_on_sport_alone(spark):
    """The tiles have all certain vetoes in their key, and hold a bounded number of names each."""
    a = spark.createDataFrame([(f"l{i}", f"League {i}", "football", "") for i in range(30)], "id string, name string, sport string, category_name string")
    none = leagues.alias_index(spark.createDataFrame([], "canonical string, aliases array<string>, group_seq int"))
    forms = league_index._forms(league_index._profiles(a, "name", "category_name", none), none)
    assert {r["gate"] for r in forms.collect()} == {"football|false|||"}
    tiles, _ = league_index._tiles(forms, forms)
    assert tiles.groupBy("tile").count().agg(F.max("count")).first()[0] <= league_index.BLOCK
