"""Names, places and times: literal cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import geo, text, timing
from linkloom.operators.events import name_pair_scores


def values(spark, pairs, f):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", f(F.col("a"), F.col("b")).alias("v"))
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def column(spark, items, f):
    return values(spark, [(x, None) for x in items], lambda a, b: f(a))


LEAST = [
    ("Chaidari", "Chaidari AO", 0.70), ("AO Chaidari", "Chaidari AO", 0.50), ("Manchester City", "Man City", 0.30),
    ("Atletico Madrid", "Atletico de Madrid", 0.55), ("Bayern Munich", "FC Bayern München", 0.40), ("Manchester United", "Man United", 0.40),
    ("Arsenal", "Arsenal", 1.0),
]
MOST = [("Arsenal", "Juventus", 0.40), ("Real Madrid", "PSG", 0.30), ("Barcelona", "Bayern Munich", 0.35)]


def test_team_similarity(spark):
    pairs = spark.createDataFrame([x[:2] for x in LEAST + MOST], "x string, y string")
    scores = {(r["x"], r["y"]): r["sim"] for r in name_pair_scores(pairs).collect()}
    got = [scores[x[:2]] for x in LEAST + MOST]
    assert all(g >= x[2] for g, x in zip(got, LEAST, strict=False))
    assert all(g <= x[2] for g, x in zip(got[len(LEAST) :], MOST, strict=True))


def test_jaro(spark):
    got = values(spark, [("arsenal", "juventus"), ("", "a"), ("same", "same"), ("martha", "marhta")], text.jaro)
    assert [round(x, 4) for x in got] == [0.5119, 0.0, 1.0, 0.9444]
    jw = values(spark, [("abcd", "abxyzw"), ("martha", "marhta")], text.jaro_winkler)
    assert [round(x, 4) for x in jw] == [round(0.6111 + 0.2 * (1 - 0.6111), 4), 0.9611]


def test_normal_forms(spark):
    assert column(spark, ["  Škoda·Plzeň_1.a,b-c 'x' ", None, ""], text.normalize_name) == ["skoda plzen 1 a b c x", "", ""]
    assert column(spark, ["FC Bayern München", "1. FC Köln", "AFC", "Saint-Étienne", "AC Milano & Co", None], text.normalize_team_name) == [
        "bayern munchen", "cologne", "afc", "saint etienne", "milan co", "",
    ]
    assert column(spark, ["Premier League 25/26 (2026)", "2. Liga"], text.normalize_league_name) == ["premier league", "2 liga"]
    assert column(spark, ["WQF1", " Winner of EC", "Arsenal", None], text.is_placeholder) == [True, True, False, False]


def test_players(spark):
    got = values(spark, [("Lionel Andres Messi", "Messi Lionel"), ("A B", "B A"), ("x", "y")], text.player_similarity)
    assert got == [1.0, 1.0, 0.0]


def test_places(spark):
    same = [("USA", "United States"), ("UK", "United Kingdom"), ("South Korea", "Korea"), ("Czech Republic", "Czechia"), ("Ivory Coast", "Cote Divoire"), ("Republic of Ireland", "Ireland"), ("UAE", "United Arab Emirates")]
    assert values(spark, same, geo.geo_similarity) == [1.0] * len(same)
    assert values(spark, [("France", "Germany")], geo.geo_similarity)[0] <= 0.5
    pairs = [("Libya", "Laos"), ("England", "England"), ("", "England"), ("Europe", "England"), ("World", "Brazil")]
    assert values(spark, pairs, geo.location_veto) == [True, False, False, False, False]
    assert values(spark, [("Austrian Bundesliga", "Austria"), ("Bundesliga", "Germany")], geo.location_veto_by_name) == [True, False]
    assert column(spark, ["spain la liga", "england premier league"], lambda c: geo.extract_country(c, {"spain": "spain", "england premier": "england"})) == ["spain", "england"]
    assert values(spark, [("ESP", "FRA"), ("ESP", ""), ("INT", "FRA")], geo.country_code_veto) == [True, False, False]


def test_times(spark):
    assert column(spark, ["2026-03-22T14:15:00+00:00", "2026-03-22T14:15:00Z", "2026-03-22T14:15:00-02:00", "x", None], timing.parse_iso) == [1774188900, 1774188900, 1774196100, 0, 0]
    assert column(spark, ["2026-03-22T14:15:00Z", "2026-03-22"], lambda c: timing.parse_iso(c, strip_zone=True)) == [1774188900, 1774137600]
    gaps = column(spark, ["0", "3600", "7200", "10800"], lambda c: timing.gaussian_time(c.cast("long"), 3600))
    assert [round(g, 4) for g in gaps] == [1.0, 0.6065, 0.1353, 0.0111]
    assert column(spark, ["0.0005", "-0.0005", "0.91449"], lambda c: timing.round3(c.cast("double"))) == [0.001, -0.001, 0.914]
    assert column(spark, ["946684800", "2000-01-01", "0", None], timing.dob_of_seconds) == ["2000-01-01", "2000-01-01", "0", ""]
    assert column(spark, ["sr:sport:2", "9"], lambda c: timing.sport_of(c, "sr")) == ["basketball", "unknown"]


def test_birthdays_of_any_year(spark):
    """Years of more than four digits without a sign (F1), and seconds beyond the last timestamp."""
    rng = random.Random(7)
    seconds = [-1, 1, 86399, 86400, 951782400, 253402300799, 253402300800, 777600000000, 9223372036854, 9223372036855, 46655991360000, 2**63 - 1]
    seconds += [-62135596800, -62167219200, -62167219201, -377705116801, -(2**62), 185542587187200, -185542587100801, 185542587187199] + [rng.randrange(10**k, 10 ** (k + 1)) * rng.choice((-1, 1)) for k in range(5, 18) for _ in range(5)]
    want = [str(np.datetime64(n, "s").astype("datetime64[D]")) for n in seconds]
    want = [f"-{d[1:].zfill(10)}" if d[0] == "-" else d for d in want]
    assert (want[7], want[10], want[14]) == ("26611-03-02", "1480439-07-06", "-0001-12-31")
    assert column(spark, [str(n) for n in seconds], timing.dob_of_seconds) == want


@pytest.mark.parametrize(
    ("name", "reason"),
    [("E-Football Cup", "e-prefix"), ("E | Football", "e|prefix"), ("Esoccer Battle", "e-joined"), ("League (E)", "(e)"), ("NBA 2K26", "nba 2k"), ("H2H GG League", "h2h gg"), ("Cup 2x5 Mins", "minutes"), ("Futsal 2x5 Mins", None), ("Premier League", None)],
)
def test_virtual(spark, name, reason):
    assert column(spark, [name], text.virtual_reason) == [reason]
