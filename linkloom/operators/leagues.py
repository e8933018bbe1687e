"""League alias index and league matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.text import let, name_similarity, normalize_name
from . import league_index
from .features import feature_penalty, league_features, league_veto

TIERS = ((0.85, "LEAGUE_NAME_HI"), (0.70, "LEAGUE_NAME_MED"), (0.55, "LEAGUE_NAME_LOW"))
#: Weights of name and place, the least place similarity at which places count, and whether a place can veto.
SR = {"name": 0.8, "place": 0.2, "least": 0.6, "strict": True, "veto": False}
LS = {"name": 0.75, "place": 0.25, "least": 0.6, "strict": False, "veto": True}


def alias_index(groups: DataFrame) -> DataFrame:
    """(alias_norm, canonical) from (canonical, aliases array, group_seq); an alias in several groups goes to the last."""
    rows = groups.select("canonical", "group_seq", F.explode(F.array_union("aliases", F.array("canonical"))).alias("alias"))
    rows = rows.select(normalize_name(F.col("alias")).alias("alias_norm"), "canonical", "group_seq").filter("alias_norm <> ''")
    w = Window.partitionBy("alias_norm").orderBy(F.col("group_seq").desc(), "canonical")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("alias_norm", "canonical")


def with_canonical(df: DataFrame, name_col: str, out: str, index: DataFrame) -> DataFrame:
    """``df`` with the canonical name of ``name_col`` (null outside the index)."""
    look = index.select(F.col("alias_norm").alias("_alias"), F.col("canonical").alias(out))
    return df.withColumn("_norm", normalize_name(F.col(name_col))).join(look, F.col("_norm") == F.col("_alias"), "left").drop("_norm", "_alias")


def alias_similarity(pairs: DataFrame, a: str, b: str, index: DataFrame, out: str = "alias_score") -> DataFrame:
    """``pairs`` with the name similarity of a and b through their aliases.

    One canonical name on both sides gives 0.98. Otherwise the best of the names, their canonical forms, and each known
    alias of one side against the other; aliases are exploded per distinct pair of names.
    """
    names = with_canonical(with_canonical(pairs.select(a, b).distinct(), a, "_ca", index), b, "_cb", index)
    return pairs.join(alias_scores(names, a, b, index, out), [a, b])


def alias_scores(names: DataFrame, a: str, b: str, index: DataFrame, out: str = "alias_score") -> DataFrame:
    """(a, b, score) of distinct pairs of names whose canonical names are ``_ca`` and ``_cb`` (null outside the index)."""
    plain = names.withColumn("_x", F.col(a)).withColumn("_y", F.col(b))
    expanded = names.withColumn("_x", F.coalesce("_ca", a)).withColumn("_y", F.coalesce("_cb", b))
    of_a = names.join(index.toDF("_x", "_ca"), "_ca").withColumn("_y", F.col(b))
    of_b = names.join(index.toDF("_y", "_cb"), "_cb").withColumn("_x", F.col(a))
    cols = [a, b, "_ca", "_cb", "_x", "_y"]
    tries = reduce(DataFrame.unionByName, [d.select(*cols) for d in (plain, expanded, of_a, of_b)])
    # each distinct pair of names is compared once, apart from the aggregation, which cannot hold an Arrow function
    compared = tries.select("_x", "_y").distinct().repartition("_x", "_y")
    compared = compared.select("_x", "_y", name_similarity(F.col("_x"), F.col("_y")).alias("_score"))
    best = tries.join(compared, ["_x", "_y"]).groupBy(a, b).agg(F.max("_score").alias("_best"), F.first(F.col("_ca") == F.col("_cb")).alias("_same"))
    return best.select(a, b, F.when(F.coalesce("_same", F.lit(False)), 0.98).otherwise(F.col("_best")).alias(out))


def league_score(name_score: Column, a: str, b: str, place_a: str, place_b: str, weights: dict = SR) -> Column:
    """The score of two leagues from their name score, features and places."""
    pa, pb = F.coalesce(F.col(place_a), F.lit("")), F.coalesce(F.col(place_b), F.lit(""))
    away = geo.location_veto(pa, pb) | geo.location_veto_by_name(F.col(a), pb) if weights["veto"] else F.lit(False)
    def total(s: Column) -> Column:
        return prepared_score(s["name"], s["fa"], s["fb"], s["g"], s["known"], s["away"], weights)

    parts = F.struct(
        league_features(F.col(a)).alias("fa"),
        league_features(F.col(b)).alias("fb"),
        geo.geo_similarity(pa, pb).alias("g"),
        ((pa != "") & (pb != "")).alias("known"),
        away.alias("away"),
        name_score.alias("name"),
    )

    return let(parts, total)


def prepared_score(name: Column, fa: Column, fb: Column, geo_score: Column, known: Column, away: Column, weights: dict) -> Column:
    """The score of two leagues whose features and places are columns already."""
    near = (geo_score > weights["least"]) if weights["strict"] else (geo_score >= weights["least"])
    base = name * feature_penalty(fa, fb)
    score = F.when(known & near, weights["name"] * base + weights["place"] * geo_score).otherwise(base)
    return F.when(away | league_veto(fa, fb).isNotNull(), 0.0).otherwise(score)


def rule_of(score: Column) -> Column:
    out = reduce(lambda c, t: c.when(score >= t[0], t[1]), TIERS, F.when(F.lit(False), ""))
    return out.otherwise("LEAGUE_NO_MATCH")


def match_leagues(leagues: DataFrame, candidates: DataFrame, index: DataFrame, known: DataFrame | None = None, weights: dict = SR) -> DataFrame:
    """The best candidate of each league (L13): (id, competition_id, confidence, rule).

    ``leagues`` is canonical; ``candidates`` has (competition_id, competition_name, sport, country, candidate_seq). A
    league in ``known`` (sport, id, competition_id) is taken as known, even if its target is no candidate; only the
    others are scored. The first candidate wins ties.
    """
    if known is not None:
        sure = leagues.join(known, ["sport", "id"]).select("id", "competition_id", F.lit(1.0).alias("confidence"), F.lit("LEAGUE_KNOWN").alias("rule"))
        rest = leagues.join(known, ["sport", "id"], "left_anti")
    else:
        sure, rest = None, leagues
    best = ranked_candidates(rest, candidates, index, weights).filter("rank = 1")
    found = best.select("id", F.when(F.col("score") >= TIERS[-1][0], F.col("competition_id")).otherwise("").alias("competition_id"), F.col("score").alias("confidence"), rule_of(F.col("score")).alias("rule"))
    return found.unionByName(sure) if sure is not None else found


def ranked_candidates(leagues: DataFrame, candidates: DataFrame, index: DataFrame, weights: dict = LS, least: float = 0.0, k: int = 5) -> DataFrame:
    """The k best candidates of each league (L14), those with ``least`` or more.

    Names are prepared once, and only pairs that can still be among the k best are scored (:mod:`.league_index`); the
    result is that of scoring every candidate of the league's sport.
    """
    named = leagues.select("id", "sport", F.col("name").alias("league_name"), "category_name")
    scored = league_index.scored_candidates(named, candidates, index, weights, least, k)
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "candidate_seq")
    return scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def all_candidates(leagues: DataFrame, candidates: DataFrame, index: DataFrame, weights: dict = LS, least: float = 0.0, k: int = 5) -> DataFrame:
    """:func:`ranked_candidates` by scoring every pair of a sport: for small tables, and to compare with."""
    named = leagues.select("id", "sport", F.col("name").alias("league_name"), "category_name")
    pairs = alias_similarity(named.join(candidates, "sport"), "league_name", "competition_name", index)
    scored = pairs.withColumn("score", league_score(F.col("alias_score"), "league_name", "competition_name", "category_name", "country", weights))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "candidate_seq")
    return scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_even_if_low(leagues: DataFrame, candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Matching by score alone: a best candidate of 0.40 or more is taken, as LOW if need be."""
    best = ranked_candidates(leagues, candidates, index, LS, least=0.40, k=1)
    rule = F.when(F.col("score") >= TIERS[-1][0], rule_of(F.col("score"))).otherwise("LEAGUE_NAME_LOW")
    return best.select("id", "competition_id", F.col("score").alias("confidence"), rule.alias("rule"))


def offline_score(a: str, b: str, country_a: str, country_b: str, discount: bool = False) -> Column:
    """The offline tools' league score (L15 with ``discount``, L16 without): place veto, boost, and a fuzzy-region factor.

    Places are compared like names. International places are spared the veto only. The discount is for a national source
    whose target has no place.
    """
    place = lambda c: F.coalesce(F.col(c), F.lit(""))
    known_a, known_b = place(country_a) != "", place(country_b) != ""
    world = geo.is_international(F.col(country_a)) | geo.is_international(F.col(country_b))
    base, g = text.offline_similarity(F.col(a), F.col(b)), text.offline_similarity(F.col(country_a), F.col(country_b))
    near = F.when(g >= 0.6, 0.75 * base + 0.25 * g).when(g >= 0.4, base * (0.70 + 0.30 * (g - 0.4) / 0.2)).otherwise(base)
    score = F.when(known_a & known_b, F.when(~world & (g < 0.4), 0.0).otherwise(near)).otherwise(base)
    lone = known_a & ~known_b & ~geo.is_international(F.col(country_a)) & (base < 0.75)
    return F.when(lone, base * 0.90).otherwise(score) if discount else score
