"""The offline matcher, conflict reasons, teams without ids, totals and stores, against rules written out by hand."""

import difflib

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import events, evidence, leagues, reports, state
from linkloom.plans import matching

from .test_plans import inputs

T0 = 1745496000


def ratio(a, b):
    x, y = (" ".join("".join(" " if c in ".-_,'\"·|" else c for c in s.lower()).split()) for s in (a, b))
    if not x or not y:
        return float(x == y)
    s, t = set(x.split()), set(y.split())
    return max(len(s & t) / len(s | t), difflib.SequenceMatcher(None, x, y).ratio())


PLACES = ["Ireland", "Iraq", "England", "", "World", "Engl", "Northern Ireland", "Peru"]
NAMES = [("Premier League", "Premier League"), ("Liga|1", "Liga 1"), ("Serie A", "Serie B"), ("", ""), ("Cup", "")]


def league_score(a, b, pa, pb, discount):
    world = {"World"}
    base, g = ratio(a, b), ratio(pa, pb)
    if pa and pb:
        if pa not in world and pb not in world and g < 0.4:
            return 0.0
        return 0.75 * base + 0.25 * g if g >= 0.6 else base * (0.70 + 0.30 * (g - 0.4) / 0.2) if g >= 0.4 else base
    return base * 0.9 if discount and pa and not pb and pa not in world and base < 0.75 else base


@pytest.mark.parametrize("discount", [False, True])
def test_offline_league_scores(spark, discount):
    rows = [(a, b, pa, pb) for a, b in NAMES for pa in PLACES for pb in PLACES]
    frame = spark.createDataFrame(rows, "a string, b string, pa string, pb string")
    for r in frame.withColumn("s", leagues.offline_score("a", "b", "pa", "pb", discount)).withColumn("n", text.offline_similarity(F.col("a"), F.col("b"))).collect():
        assert r["n"] == pytest.approx(ratio(r["a"], r["b"]))
        assert r["s"] == pytest.approx(league_score(r["a"], r["b"], r["pa"], r["pb"], discount)), r


def games(spark, rows):
    return spark.createDataFrame([("L", *r) for r in rows], "league_id string, event_id string, start_unix long, home_id string, home_name string, away_id string, away_name string")


def test_teams_without_ids_are_told_apart_by_name(spark):
    s = games(spark, [("s1", T0, "", "Arsenal", "", "Chelsea")])
    t = games(spark, [("t1", T0, "", "Juventus", "", "Torino"), ("t2", T0 + 90 * 86400, "", "Arsenal", "", "Chelsea")])
    got = events.match_events(s, t).first()
    assert (got["target_id"], got["rule"]) == ("", "EVENT_NO_MATCH") and got["home_id"] == ""
    same = events.match_events(s, games(spark, [("t3", T0 + 60, None, "Arsenal", "9", "Chelsea")])).first()
    assert (same["target_id"], same["rule"], same["target_home_id"], same["target_away_id"]) == ("t3", "EVENT_L1", "", "9")


def test_level_major(spark):
    s = games(spark, [("a", T0, "1", "Real|Madrid", "2", "Barcelona"), ("b", 0, "3", "Porto", "4", "Benfica"), ("c", T0 + 9000, "1", "Real Madrid", "2", "Barcelona B")])
    t = games(spark, [("x", T0 + 200, "5", "barcelona", "6", "real madrid"), ("y", 0, "7", "Porto", "8", "Benfica"), ("z", T0 + 20000, "5", "Barcelona", "6", "Real Madrid")])
    got = {r["event_id"]: (r["target_id"], r["rule"], r["confidence"]) for r in events.level_major(s, t).collect()}
    near = round((1.0 + ratio("Barcelona", "Barcelona B")) / 2, 4)
    assert got == {"a": ("x", "EVENT_L1", 1.0), "b": ("", "EVENT_NO_MATCH", 0.0), "c": ("z", "EVENT_L2", near)}


def test_known_leagues_of_the_bulk_run(spark):
    given = inputs(spark)
    known = spark.createDataFrame([("football", "L1", "C2")], "sport string, id string, competition_id string")
    found = matching.bulk(matching.Inputs(**{**given.__dict__, "known": known}))
    assert [(r["competition_id"], r["confidence"], r["rule"]) for r in found.leagues.collect()] == [("C2", 1.0, "LEAGUE_KNOWN")]
    export = matching.league_export(given.tournaments, given.target_tournaments).collect()
    assert {r["id"]: r["competition_id"] for r in export}["L1"] == "C1"


def sorted_pass(rows, least):
    sources, targets, lost = {}, {}, []
    for e, t, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if s < least:
            lost.append((e, t, None, None, "BELOW_AUTO_THRESHOLD"))
        elif e in sources:
            lost.append((e, t, *sources[e], "CONFLICT_SR_USED"))
        elif t in targets:
            lost.append((e, t, *targets[t], "CONFLICT_TS_USED"))
        else:
            sources[e] = targets[t] = (e, t)
    return sorted(lost)


def test_reasons_of_conflicts(spark):
    rows = [("s1", "t1", 1.0), ("s1", "t2", 0.9), ("s2", "t2", 0.8), ("s2", "t1", 0.75), ("s3", "t2", 0.7), ("s4", "t4", 0.1), ("s5", "t1", 0.95), ("s5", "t5", 0.97), ("s5", "t2", 0.5)]
    rows += [(f"c{i:03}", f"d{j:03}", round(0.99 - 0.001 * (i + j) / 2, 6)) for i in range(400) for j in (i, i + 1)]
    edges = spark.createDataFrame([(e, t, "", s) for e, t, s in rows], "event_id string, target_id string, competition_id string, score double")
    _, lost = evidence.resolve(edges, 0.2)
    got = lost.collect()
    key = ("event_id", "target_id", "winner_event_id", "winner_target_id", "reason")
    assert sorted(tuple(r[c] for c in key) for r in got) == sorted_pass(rows, 0.2)
    assert all(r["gap"] is None or r["gap"] >= 0 for r in got)


def test_totals(spark):
    m = spark.createDataFrame([("a", True, 0.9, "EVENT_L1"), ("a", True, 0.7, "EVENT_L2"), ("b", False, 0.0, "EVENT_NO_MATCH"), ("b", True, 0.5, "EVENT_L1")], "sport string, matched boolean, confidence double, rule string")
    total = reports.with_totals(reports.match_stats(m, ["sport"]), "sport").filter("sport = 'TOTAL'").first()
    assert (total["total"], total["n_matched"], total["n_event_l1"], total["rate"], total["avg_confidence"]) == (4, 3, 2, 0.75, 0.7)


def test_a_store_survives_a_write_that_died(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s", "id bigint")
    store.write(spark.range(1))
    (tmp_path / "s" / "data" / "dead").mkdir()
    (tmp_path / "s" / "open" / "dead").write_text("{")
    store.write(spark.range(2))
    store.write(spark.range(3))
    assert store.read().count() == 3


def test_equal_times_in_a_store_give_one_result(spark):
    rows = [("team", "a", "x", "football", 1, c, 10, "learned") for c in (0.5, 0.9, 0.7)]
    for order in (rows, rows[::-1]):
        assert state.upsert(spark.createDataFrame(order[:1], state.COLUMNS), spark.createDataFrame(order[1:], state.COLUMNS)).first()["confidence"] == 0.9
