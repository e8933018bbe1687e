"""Event matching, votes, players, evidence: literal cases and a plain reference for the kernel."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import evidence, events, scoring, state, teams

EVENT = "league_id string, event_id string, start_unix bigint, home_id string, home_name string, away_id string, away_name string"
T0 = 1745496000


def frame(spark, rows):
    return spark.createDataFrame([("L", i, t, h.lower(), h, a.lower(), a) for i, t, h, a in rows], EVENT)


def matched(spark, source, target, team_map=None):
    rows = events.match_events(frame(spark, source), frame(spark, target), team_map).collect()
    return {r["event_id"]: (r["target_id"], r["rule"], r["confidence"]) for r in rows}


def test_cases(spark):
    got = matched(spark, [("s", T0, "Arsenal", "Chelsea")], [("t", T0 + 300, "Arsenal", "Chelsea")])
    assert got["s"][:2] == ("t", "EVENT_L1")
    got = matched(spark, [("s", T0, "Real Madrid", "Barcelona")], [("t", T0 + 28800, "Real Madrid", "Barcelona")])
    assert got["s"][:2] == ("t", "EVENT_L2")
    got = matched(spark, [("s", 1745535600, "Juventus", "Inter Milan")], [("t", 1745467200, "Juventus", "Inter Milan")])
    assert got["s"][:2] == ("t", "EVENT_L3")
    got = matched(spark, [("s", T0, "Arsenal", "Chelsea")], [("t", T0 + 60, "Chelsea", "Arsenal")])
    assert got["s"][1] == "EVENT_NO_MATCH"
    got = matched(spark, [("s1", T0, "Liverpool", "Everton"), ("s2", T0 + 3600, "Liverpool", "Everton")], [("t", T0 + 60, "Liverpool", "Everton")])
    assert got["s1"][0] == "t" and got["s2"][1] == "EVENT_NO_MATCH"


def test_late_levels(spark):
    day = 86400
    source = [("s1", T0, "Arsenal", "Chelsea"), ("s2", T0 + 5 * day, "Arsenal", "Chelsea")]
    got = matched(spark, source, [("t1", T0, "Arsenal", "Chelsea"), ("t2", T0 + 7 * day, "Arsenal", "Chelsea")])
    assert got["s2"][:2] == ("t2", "EVENT_L4")
    one = [("t", T0 + 10 * day, "Arsenal", "Chelsea")]
    assert matched(spark, [("s", T0, "Arsenal", "Chelsea")], one)["s"][1] == "EVENT_L5"
    two = [*one, ("u", T0 + 11 * day, "Arsenal", "Chelsea")]
    assert matched(spark, [("s", T0, "Arsenal", "Chelsea")], two)["s"][1] == "EVENT_NO_MATCH"
    team_map = spark.createDataFrame([("L", "aaa", "zzz"), ("L", "bbb", "qqq")], "league_id string, s string, t string")
    got = matched(spark, [("s", T0, "Aaa", "Bbb")], [("t", T0 + 200 * day, "Zzz", "Qqq")], team_map)
    assert got["s"] == ("t", "EVENT_L4B", 0.75)
    slots = [("s", T0, "WQF1", "WQF2")]
    assert matched(spark, slots, [("t", T0 + 200, "Xx", "Yy")])["s"] == ("t", "EVENT_L6", 0.7)
    assert matched(spark, slots, [("t", T0 + 200, "Xx", "Yy"), ("u", T0 + 100, "Vv", "Ww")])["s"][1] == "EVENT_NO_MATCH"


def test_best_of_each_level_is_one_to_one(spark):
    rng = random.Random(2)
    clubs = ["Arsenal", "Chelsea", "Everton", "Leeds United", "Leeds", "Porto", "FC Porto", "Benfica"]
    make = lambda n, p: [(f"{p}{i}", T0 + rng.randrange(40) * 7200, *rng.sample(clubs, 2)) for i in range(n)]
    got = matched(spark, make(60, "s"), make(60, "t"))
    used = [t for t, *_ in got.values() if t]
    assert len(used) == len(set(used)) and len(used) > 10
    major = events.level_major(frame(spark, make(40, "s")), frame(spark, make(40, "t"))).filter("matched").collect()
    assert len({r["target_id"] for r in major}) == len(major)


def test_votes(spark):
    rows = [("L", True, 0.9, "a", "x", "b", "y"), ("L", True, 0.8, "a", "x", "c", "z"), ("L", True, 0.7, "b", "y", "a", "w"), ("L", False, 0.0, "a", "w", "b", "w")]
    m = spark.createDataFrame(rows, "league_id string, matched boolean, confidence double, home_id string, target_home_id string, away_id string, target_away_id string")
    got = {r["s"]: (r["t"], r["votes"]) for r in teams.map_teams(m).collect()}
    assert got == {"a": ("x", 2), "b": ("y", 2), "c": ("z", 1)}
    names = spark.createDataFrame([("a", "Arsenal"), ("x", "Arsenal"), ("b", "B"), ("y", "Q"), ("c", "C"), ("z", "C")], "id string, name string")
    assert {r["s"]: r["confidence"] for r in teams.map_teams(m, names).collect()}["a"] == round(0.6 * 2 / 3 + 0.4, 3)


def test_players_and_overlap(spark):
    kind = "id string, name string, full_name string, birthday string, nationality string, team_id string, source string"
    s = spark.createDataFrame([("p1", "Lionel Messi", "", "1987-06-24", "", "a", "sr"), ("p2", "Luis Suarez", "", "", "", "a", "sr"), ("p3", "Nobody", "", "", "", "a", "sr")], kind)
    t = spark.createDataFrame([("q1", "Messi Lionel", "", "1987-06-24", "", "x", "ts"), ("q2", "Luis Suarez Diaz", "", "", "", "x", "ts")], kind)
    mapped = spark.createDataFrame([("L", "a", "x", 3, 0.8)], "league_id string, s string, t string, votes int, confidence double")
    found = teams.match_players(s, t, mapped)
    got = {r["player_id"]: (r["target_player_id"], r["rule"]) for r in found.collect()}
    assert got["p1"] == ("q1", "PLAYER_NAME_HI") and "p3" not in got
    overlap = teams.player_overlap(s, found).collect()[0]
    assert overlap["bonus"] == {1: 0.03, 2: 0.15}[len(got)]


PAIR = (
    "event_id string, start_unix bigint, home_id string, home_name string, away_id string, away_name string, target_id string, target_time bigint, "
    "target_home_id string, target_home_name string, target_away_id string, target_away_name string, competition_id string, candidate_score double, "
    "home_team_candidate_score double, away_team_candidate_score double, strong_constraint_ok boolean, offset bigint, mapped_home string, mapped_away string"
)


def pair(e, start, h, a, t, time, th, ta, comp="c", offset=0, maps=(None, None)):
    return (e, start, h.lower(), h, a.lower(), a, t, time, "t" + th.lower(), th, "t" + ta.lower(), ta, comp, 0.95, 0.95, 0.95, True, offset, *maps)


@pytest.mark.parametrize(("compat", "plain", "reversed_"), [(True, 0.915, 0.795), (False, 0.994, 0.874)])
def test_evidence(spark, compat, plain, reversed_):
    model = scoring.Model.default(compat)
    rows = [pair("s1", T0, "Arsenal", "Chelsea", "t", T0, "Arsenal", "Chelsea"), pair("s2", T0 + 300, "Arsenal", "Chelsea", "t", T0, "Arsenal", "Chelsea")]
    won, lost = evidence.resolve(evidence.edges(spark.createDataFrame(rows, PAIR), model))
    assert [(r["event_id"], r["score"]) for r in won.collect()] == [("s1", plain)]
    assert [(r["event_id"], r["reason"]) for r in lost.collect()] == [("s2", "CONFLICT_TS_USED")]
    back = evidence.edges(spark.createDataFrame([pair("s", T0, "Arsenal", "Chelsea", "t", T0, "Chelsea", "Arsenal")], PAIR), model).collect()[0]
    assert back["score"] == reversed_ and "SIDE_REVERSED" in back["reasons"]


def test_greedy_is_the_sorted_pass(spark):
    rng = random.Random(9)
    rows = [(f"s{rng.randrange(30):02}", f"t{rng.randrange(30):02}", "c", round(rng.random(), 2)) for _ in range(250)]
    rows = list({(s, t): (s, t, c, v) for s, t, c, v in rows}.values())
    won, _ = evidence.resolve(spark.createDataFrame(rows, "event_id string, target_id string, competition_id string, score double"), 0.2)
    used, want = set(), set()
    for s, t, _, v in sorted(rows, key=lambda r: (-r[3], r[0], r[1])):
        if v >= 0.2 and s not in used and t not in used:
            used |= {s, t}
            want.add((s, t))
    assert {(r["event_id"], r["target_id"]) for r in won.collect()} == want


def test_model(spark):
    perfect = spark.createDataFrame([(2, 2, 2, 2, 2)], "home_name int, away_name int, time_diff int, league_tier int, sport int")
    for compat, want, share in ((True, -23.002, 0.0005), (False, 14.953, 0.9932)):
        row = perfect.select(scoring.score(scoring.Model.default(compat)).alias("s")).select("s", scoring.normalized(F.col("s")).alias("n")).first()
        assert round(row["s"], 3) == want and round(row["n"], 4) == share
    rng = random.Random(1)
    rows = [(2, 2, 2, 2, 2) if rng.random() < 0.2 else (rng.choice([0, 0, 1]), 0, rng.choice([0, 1]), rng.choice([0, 2]), 2) for _ in range(500)]
    model = scoring.fit(spark.createDataFrame(rows, "home_name int, away_name int, time_diff int, league_tier int, sport int"))
    assert abs(model.prior - sum(r[:3] == (2, 2, 2) for r in rows) / 500) < 0.02


def test_offsets(spark):
    gaps = spark.createDataFrame([("a", g) for g in (100, 110, 90, 5000)] + [("b", 5)], "league_id string, gap bigint")
    got = {r["league_id"]: (r["offset"], r["valid"]) for r in scoring.offsets(gaps, ["league_id"]).collect()}
    assert got == {"a": (105, True), "b": (5, False)}


def test_stores(spark, tmp_path):
    store = state.alias_store(spark, f"file://{tmp_path}/aliases")
    rows = lambda *x: spark.createDataFrame([("team", s, t, "football", v, c, at, o) for s, t, v, c, at, o in x], state.COLUMNS)
    store.write(state.upsert(store.read(), rows(("a", "x", 1, 0.5, 10, "learned"), ("a", "y", 1, 0.9, 11, "learned"))))
    store.write(state.upsert(store.read(), rows(("a", "x", 1, 0.7, 20, "learned"), ("b", "z", 1, 0.7, 20, "manual"))))
    now = {(r["src_id"], r["ts_id"]): (r["votes"], r["confidence"]) for r in store.read().collect()}
    assert now == {("a", "x"): (2, 0.7), ("a", "y"): (1, 0.9), ("b", "z"): (1, 0.7)}
    assert [(r["src_id"], r["ts_id"]) for r in state.best_aliases(store.read()).collect()] == [("a", "x")]
    assert {r["src_id"] for r in state.best_league_aliases(store.read()).collect()} == {"a", "b"}
    assert state.prune(store.read(), as_of=100 * 86400).count() == 1


def _greedy(rows):
    sources, targets, out = set(), set(), []
    for e, t, _, s in sorted(rows, key=lambda r: (-r[3], r[0], r[1])):
        if e not in sources and t not in targets:
            sources.add(e)
            targets.add(t)
            out.append((e, t, s))
    return sorted(out)


@pytest.mark.parametrize("at_once", [None, 500])
def test_resolution_ends_with_the_last_edge(spark, monkeypatch, at_once):
    if at_once:
        monkeypatch.setattr(evidence, "PASS", at_once)
    tied = [(f"e{i:03}", f"t{j:03}", "", 0.7) for i in range(0, 130) for j in range(max(0, i - 6), min(130, i + 7))]
    chain = [(f"c{i:03}", f"d{j:03}", "", round(0.5 + 0.002 * (i + j), 3)) for i in range(110) for j in (i, i + 1)]
    edges = spark.createDataFrame(tied + chain, "event_id string, target_id string, competition_id string, score double")
    won, lost = evidence.resolve(edges, 0.2, **({"rounds": 2} if at_once else {}))
    got = sorted((r["event_id"], r["target_id"], r["score"]) for r in won.collect())
    assert got == _greedy(tied + chain)
    assert lost.count() == len(tied + chain) - len(got)
    assert lost.filter("winner_event_id is null or winner_target_id is null").count() == 0
