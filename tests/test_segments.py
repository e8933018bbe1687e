"""Large leagues by segments: the result of one ordered pass."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import events, segments

EVENT = "league_id string, event_id string, start_unix bigint, home_id string, home_name string, away_id string, away_name string"
T0 = 1745496000
CLUBS = ["Arsenal", "Chelsea", "Everton", "Leeds United", "Leeds", "Porto", "FC Porto", "Benfica", "Ajax", "PSV Eindhoven"]


def games(rng, n, prefix, days, league="L", other_names=False):
    out = []
    for i in range(n):
        h, a = rng.sample(range(len(CLUBS)), 2)
        name = CLUBS[h]
        if other_names and rng.random() < 0.3:
            name = rng.choice([name + " FC", name[:-1], name.upper(), "Xyzzy " + name[:3]])
        start = rng.choice([None, 0]) if rng.random() < 0.04 else T0 + rng.randrange(days * 24) * 3600 + rng.choice([0, 0, 300, 1800])
        out.append((league, f"{prefix}{i:04}", start, f"{prefix}h{h}", name, rng.choice([f"{prefix}h{a}", None]) if other_names else f"{prefix}h{a}", CLUBS[a]))
    return out


def sides(spark, seed, n=120, days=45):
    rng = random.Random(seed)
    source = games(rng, n, "s", days, other_names=True) + games(rng, 15, "s", 9, "M")
    target = games(rng, n, "t", days) + games(rng, 20, "t", 9, "M") + games(rng, 3, "t", 9, "no source")
    return spark.createDataFrame(source, EVENT), spark.createDataFrame(target + target[:5], EVENT)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_are_the_ordered_pass(spark, seed):
    source, target = sides(spark, seed)
    team_map = spark.createDataFrame([("L", f"sh{i}", f"th{i}") for i in range(0, 10, 2)], "league_id string, s string, t string") if seed == 2 else None
    want = rows(events.match_events(source, target, team_map))
    assert rows(events.match_events(source, target, team_map, size=12)) == want
    assert len({r[3] for r in want}) >= 4
    assert len(want) == 135


def test_levels_are_the_ordered_pass(spark):
    source, target = sides(spark, 3)
    want = rows(events.level_major(source, target))
    assert rows(events.level_major(source, target, size=12)) == want
    assert len({r[3] for r in want}) >= 3


def test_aliases_go_from_segment_to_segment(spark):
    """A team under another name is learned early and found by its alias a year later, far from every other segment."""
    day = 86400
    source = [("L", f"s{i}", T0 + i * 40 * day, "a", "Arsenal", "c", "Chelsea") for i in range(10)]
    source.append(("L", "late", T0 + 500 * day, "a", "Totally Different", "c", "Chelsea"))
    target = [("L", f"t{i}", T0 + i * 40 * day, "ta", "Arsenal", "tc", "Chelsea") for i in range(10)]
    target.append(("L", "tlate", T0 + 502 * day, "ta", "Arsenal", "tc", "Chelsea"))
    s, t = spark.createDataFrame(source, EVENT), spark.createDataFrame(target, EVENT)
    got = {r["event_id"]: (r["target_id"], r["rule"]) for r in events.match_events(s, t, size=1).collect()}
    assert got["late"] == ("tlate", "EVENT_L4")
    assert got == {r["event_id"]: (r["target_id"], r["rule"]) for r in events.match_events(s, t).collect()}


def test_no_cell_holds_a_large_league(spark):
    """One league with a third of all rows: its cells are no larger than those of others."""
    rng = random.Random(5)
    many = [x for i in range(20) for x in games(rng, 40, "s", 60, f"l{i}")]
    s = segments.event_rows(spark.createDataFrame(many + games(rng, 400, "s", 600, "hot"), EVENT), "s", F.col("home_id"), F.col("away_id"))
    sizes = segments.with_segments(s, 40).groupBy("league_id", "seg").count()
    assert sizes.filter("league_id = 'hot'").count() >= 10
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 40


def test_empty(spark):
    none = spark.createDataFrame([], EVENT)
    some, _ = sides(spark, 4, 5)
    assert events.match_events(none, some).count() == 0
    assert {r["rule"] for r in events.match_events(some, none, size=2).collect()} == {"EVENT_NO_MATCH"}
    assert events.level_major(some, none, size=2).filter("matched").count() == 0
