"""Evidence-first matching: one to one, swapped sides, a shifted pool, repeated fixtures, several competitions, team ids, aliases."""

import random

import pytest

from linkloom.operators import evidence, scoring

from .test_events import PAIR, T0, pair

DAY = 86400


def match(spark, rows, **how):
    won, lost = evidence.two_rounds(spark.createDataFrame(rows, PAIR), **how)
    return {r["event_id"]: r for r in won.collect()}, lost.collect()


def cross(sources, targets, comp="c"):
    return [pair(e, s, h, a, t, u, th, ta, comp) for e, s, h, a in sources for t, u, th, ta in targets]


def test_one_to_one(spark):
    won, lost = match(spark, cross([("s1", 1000, "Alpha FC", "Beta FC"), ("s2", 1300, "Alpha FC", "Beta FC")], [("t1", 1000, "Alpha FC", "Beta FC")]))
    assert set(won) == {"s1"}
    assert [(r["reason"], r["winner_target_id"], r["gap"] >= 0) for r in lost] == [("CONFLICT_TS_USED", "t1", True)]


def test_swapped_sides(spark):
    won, _ = match(spark, cross([("s1", 2000, "Home United", "Away City")], [("t1", 2000, "Away City", "Home United")]))
    assert won["s1"]["side_reversed"] and "SIDE_REVERSED" in won["s1"]["reasons"] and won["s1"]["score"] < 0.95


def test_pool_a_day_late(spark):
    teams = [("Alpha", "Beta"), ("Gamma", "Delta"), ("Epsilon", "Zeta")]
    rows = cross([(f"s{i}", 10_000 * (i + 1), h, a) for i, (h, a) in enumerate(teams)], [(f"t{i}", 10_000 * (i + 1) + DAY, h, a) for i, (h, a) in enumerate(teams)])
    offsets = evidence.estimated_offsets(spark.createDataFrame(rows, PAIR)).collect()
    assert [r["offset"] for r in offsets] == [DAY]
    won, _ = match(spark, rows, shifted=True)
    assert {e: r["target_id"] for e, r in won.items()} == {f"s{i}": f"t{i}" for i in range(3)}
    assert all(r["time_diff"] == 0 and "DTW_OFFSET" in r["reasons"] for r in won.values())


def test_offset_of_each_pool(spark):
    teams = [("Alpha", "Beta"), ("Gamma", "Delta"), ("Epsilon", "Zeta")]
    late = lambda comp, by: cross([(f"{comp}{i}", 10_000 * i + 5, h, a) for i, (h, a) in enumerate(teams)], [(f"t{comp}{i}", 10_000 * i + 5 + by, h, a) for i, (h, a) in enumerate(teams)], comp)
    rows = late("x", -7200) + late("y", 0) + late("z", 100)
    got = {(r["competition_id"], r["offset"]) for r in evidence.with_offsets(spark.createDataFrame(rows, PAIR), "competition_id").collect()}
    assert got == {("x", -7200), ("y", 0), ("z", 0)}


def test_anchor_is_ambiguous_however_far_away(spark):
    rows = spark.createDataFrame([("L", "s", "t1", 60, 0.9), ("L", "s", "t2", 40 * DAY, 0.95), ("L", "u", "t3", 50, 0.86), ("L", "v", "t4", 8 * DAY, 1.0)], "league_id string, s string, t string, gap bigint, name double")
    assert [(r["s"], r["t"]) for r in scoring.anchors(rows).collect()] == [("u", "t3")]


def test_correction_moves_the_source(spark):
    events = spark.createDataFrame([("L", 1000), ("M", 1000)], "league_id string, start_unix bigint")
    offset = spark.createDataFrame([("L", 3600, 5, 10, True), ("M", 3600, 5, 30_000, True)], "league_id string, offset bigint, n bigint, mad bigint, valid boolean")
    assert {r["league_id"]: (r["start_unix"], r["offset_applied"]) for r in scoring.corrected(events, offset).collect()} == {"L": (4600, 3600), "M": (1000, 0)}


def test_same_teams_again(spark):
    rows = cross([("s1", 100_000, "Arsenal", "Chelsea"), ("s2", 100_000 + DAY, "Arsenal", "Chelsea")], [("t1", 100_000, "Arsenal", "Chelsea"), ("t2", 100_000 + DAY, "Arsenal", "Chelsea")])
    won, _ = match(spark, rows)
    assert {e: r["target_id"] for e, r in won.items()} == {"s1": "t1", "s2": "t2"}


def test_several_competitions(spark):
    source = [("s1", 50_000, "Lions", "Tigers")]
    rows = cross(source, [("wrong", 50_000, "Lions", "Panthers")], "wrong-comp") + cross(source, [("right", 50_030, "Lions", "Tigers")], "right-comp")
    won, _ = match(spark, rows)
    assert (won["s1"]["target_id"], won["s1"]["competition_id"]) == ("right", "right-comp")


def test_team_ids_in_place_of_names(spark):
    row = pair("s1", 70_000, "Completely Different Home", "Completely Different Away", "t1", 70_000 + 3 * DAY, "Unrelated Name One", "Unrelated Name Two", maps=("tunrelated name one", "tunrelated name two"))
    won, _ = evidence.resolve(evidence.edges(spark.createDataFrame([row], PAIR)))
    r = won.first()
    assert r["rule"] == "EVENT_L4B" and "TEAM_ID_FALLBACK" in r["reasons"]


def test_aliases(spark):
    rows = [pair("s1", T0, "Qwertz", "Chelsea", "t1", T0, "Arsenal", "Chelsea"), pair("s2", T0, "Leeds", "Porto", "t2", T0, "Leeds", "Porto")]
    pairs = spark.createDataFrame(rows, PAIR)
    plain = {r["event_id"]: r for r in evidence.edges(pairs).collect()}
    known = spark.createDataFrame([("qwertz", "tarsenal"), ("porto", "other"), ("", "")], "s string, t string")
    got = {r["event_id"]: r for r in evidence.edges(pairs, aliases=known).collect()}
    assert "ALIAS_HIT" in got["s1"]["reasons"] and got["s1"]["score"] > plain["s1"]["score"] + 0.04
    assert got["s2"] == plain["s2"]


def test_second_round_reads_what_the_first_learned(spark):
    rows = [pair("s1", T0, "Arsenal", "Chelsea", "t1", T0, "Arsenal", "Chelsea"), pair("s2", T0 + 40 * DAY, "Arsenal", "Chelsea", "t2", T0 + 40 * DAY + 50, "Arsenal", "Chelsea")]
    once, _ = match(spark, rows)
    more, _ = match(spark, rows, learn=True)
    assert all("ALIAS_HIT" not in r["reasons"] for r in once.values())
    assert all("ALIAS_HIT" in r["reasons"] and r["score"] >= once[e]["score"] for e, r in more.items())


def test_constraint_with_a_reason(spark):
    pairs = spark.createDataFrame([pair("s1", T0, "A", "B", "t1", T0, "A", "B")], PAIR)
    from pyspark.sql import functions as F

    assert evidence.edges(pairs.withColumn("strong_constraint_ok", F.lit(False)).withColumn("strong_constraint_reason", F.lit("other sport"))).count() == 0
    assert evidence.edges(pairs.withColumn("strong_constraint_reason", F.lit("x"))).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_near_ties_against_a_plain_pass(spark, seed):
    rng = random.Random(seed)
    clubs = ["Arsenal", "Arsenals", "Chelsea", "Chelseas", "Porto"]
    sources = [(f"s{i:02}", T0 + rng.randrange(3) * 60, *rng.sample(clubs, 2)) for i in range(8)]
    targets = [(f"t{i:02}", T0 + rng.randrange(3) * 60, *rng.sample(clubs, 2)) for i in range(8)]
    scored = evidence.edges(spark.createDataFrame(cross(sources, targets), PAIR))
    used, want = set(), set()
    for r in sorted(scored.collect(), key=lambda r: (-r["score"], r["event_id"], r["target_id"])):
        if r["score"] >= evidence.LEAST and not {r["event_id"], r["target_id"]} & used:
            used |= {r["event_id"], r["target_id"]}
            want.add((r["event_id"], r["target_id"]))
    won, _ = evidence.resolve(scored)
    assert {(r["event_id"], r["target_id"]) for r in won.collect()} == want
