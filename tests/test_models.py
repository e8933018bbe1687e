"""Models of leagues that are kept between runs."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import fixed
from linkloom.operators import scoring

PAIRS = "league_id string, home_name int, away_name int, time_diff int, league_tier int, sport int"


def comparisons(seed, leagues=("a", "b"), n=60):
    rng = random.Random(seed)
    agree = lambda: (2, 2, rng.choice([2, 2, 1]), 2, 2)
    other = lambda: (rng.choice([0, 0, 1]), 0, rng.choice([0, 1]), rng.choice([0, 2]), 2)
    return [(league, *(agree() if rng.random() < 0.3 else other())) for league in leagues for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_updates_are_a_fit_on_the_union(spark, tmp_path):
    store = scoring.model_store(spark, f"file://{tmp_path}/models")
    first, second = comparisons(1), comparisons(2, ("a", "c"))
    few = comparisons(3, ("d",), 4)
    scoring.learn(store, spark.createDataFrame(first + few, PAIRS))
    scoring.learn(store, spark.createDataFrame(second, PAIRS))
    want = rows(scoring.fit_leagues(spark.createDataFrame(first + second, PAIRS)))
    assert rows(scoring.stored_models(store)) == want
    assert {r[0] for r in want} == {"a", "b", "c"} and len(want) == 3 * 15
    # a league that had too few is taken once it has enough
    scoring.learn(store, spark.createDataFrame(few + comparisons(4, ("d",), 1), PAIRS))
    assert {r[0] for r in rows(scoring.stored_models(store))} == {"a", "b", "c", "d"}


def test_fit_of_one_league_is_the_plain_fit(spark):
    pairs = spark.createDataFrame(comparisons(5, ("a",)), PAIRS)
    plain = scoring.fit(pairs)
    got = {(r["field"], r["level"]): (r["m"], r["u"]) for r in scoring.fit_leagues(pairs).collect()}
    for i, f in enumerate(fixed.FS_FIELDS):
        for k in range(3):
            assert got[f, k] == pytest.approx((plain.match[i][k], plain.other[i][k]))


def test_scores_by_league(spark):
    pairs = spark.createDataFrame(comparisons(6), PAIRS).filter("league_id = 'a'").unionByName(spark.createDataFrame(comparisons(7, ("none",), 5), PAIRS))
    models = scoring.fit_leagues(spark.createDataFrame(comparisons(6), PAIRS))
    own = scoring.fit(spark.createDataFrame(comparisons(6, ("a", "b")), PAIRS).filter("league_id = 'a'"))
    scored = scoring.score_by_league(pairs, models)
    check = scored.withColumn("want", F.when(F.col("league_id") == "a", scoring.score(own)).otherwise(scoring.score(scoring.Model.default())))
    assert all(r["score"] == pytest.approx(r["want"]) for r in check.collect())
