"""The best candidates of each league without scoring every pair of a sport.

Leagues and candidates are reduced to their distinct (sport, name, place), and everything that a score needs of a name or
a place is computed once for each. What would veto a pair for certain (women, age, region, short formats, drafts, all-star
games) is a key: only names with equal keys meet, in tiles of about ``BLOCK`` names of either side. In a tile no pair
becomes a row: from the characters, words and places of the two lists a bound is computed that no score of a pair can
exceed. The pairs with the highest bounds are scored first; the k-th best score of a league is the measure for all
others, and only pairs whose bound reaches it are scored as well. So the result is that of scoring everything.

A name goes by all its forms: itself, its canonical name, and the aliases of that. A candidate that scores nothing can
only be among the k best if it is among the first k of its sport, so those are scored, too.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, kernels
from ..functions.text import normalize_name, token_set
from . import leagues as league_rules
from .features import league_features
from .lineage import cut

BLOCK = 2000
#: Pairs with the highest bounds that a form of a league's name has scored in each tile, beyond k.
FIRST = 8
#: What equal canonical names score.
SAME = 0.98
FORM = "side string, tile string, id bigint, norm string, words bigint, mask bigint, canonical string, places bigint, known boolean, bound double"


def _profiles(rows: DataFrame, name: str, place: str, index: DataFrame) -> DataFrame:
    """Distinct (sport, name, place) with an id, features, places and canonical name."""
    rows = rows.select("sport", F.coalesce(F.col(name), F.lit("")).alias("name"), F.coalesce(F.col(place), F.lit("")).alias("place")).distinct()
    rows = rows.withColumn("id", F.xxhash64("sport", "name", "place")).repartition("id")
    country = geo.place_form(geo.country_of_league(normalize_name(F.col("name"))))
    made = rows.select("*", league_features(F.col("name")).alias("f"), geo.place_form(F.col("place")).alias("p"), country.alias("c"))
    return cut(league_rules.with_canonical(made, "name", "canonical", index))


def _gate() -> Column:
    """What two leagues must have in common, or a veto falls."""
    kind = F.col("f.comp_type")
    own = F.when(kind.isin("short_format", "draft", "all_star"), kind).otherwise("")
    return F.concat_ws("|", "sport", (F.col("f.gender") == "women").cast("string"), "f.age_group", "f.region", own)


def _mask(words: Column) -> Column:
    """One bit of 62 for each word; equal words have equal bits."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(62)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(bit(w)))


def _forms(profiles: DataFrame, index: DataFrame) -> DataFrame:
    """The forms of each profile's name, one row each, with what bounds are made of."""
    plain = profiles.withColumn("form", F.col("name"))
    more = profiles.filter("canonical is not null")
    aliases = more.join(index.select(F.col("canonical").alias("_c"), F.col("alias_norm").alias("form")), F.col("canonical") == F.col("_c")).drop("_c")
    every = reduce(DataFrame.unionByName, [plain, more.withColumn("form", F.col("canonical")), aliases])
    norm = normalize_name(F.col("form"))
    group = F.concat(F.lit("group "), F.col("p.group").cast("string"))
    at = F.array_compact(F.concat(F.col("p.words"), F.array(F.col("p.norm"), group)))
    rows = every.select(_gate().alias("gate"), "id", norm.alias("norm"), "canonical", _mask(at).alias("places"), F.col("p.known").alias("known")).distinct()
    return rows.withColumn("words", F.size(token_set(F.col("norm"))).cast("long")).withColumn("mask", _mask(token_set(F.col("norm"))))


def _tiles(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides replicated to the tiles of their gate that they are in."""

    def many(d: DataFrame, out: str) -> DataFrame:
        return d.groupBy("gate").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(out))

    gates = many(a, "na").join(many(b, "nb"), "gate")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("string")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).cast("string")
    a = a.join(gates, "gate").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("tile", F.concat_ws("/", "gate", own("na"), F.col("_o").cast("string")))
    b = b.join(gates, "gate").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("tile", F.concat_ws("/", "gate", F.col("_o").cast("string"), own("nb")))
    return a.drop("_o", "na", "nb"), b.drop("_o", "na", "nb")


def bounds(a: pd.DataFrame, b: pd.DataFrame, weights: dict) -> np.ndarray:
    """What no score of a form of ``a`` with one of ``b`` exceeds."""
    (ca, la), (cb, lb) = kernels.characters(a["norm"].tolist()), kernels.characters(b["norm"].tolist())
    col = lambda d, c: d[c].to_numpy()
    name = kernels.most_winkler(ca, la, cb, lb)
    wa, wb = col(a, "words")[:, None], col(b, "words")[None, :]
    share = (col(a, "mask")[:, None] & col(b, "mask")[None, :]) != 0
    name = np.maximum(name, np.where(share, np.minimum(wa, wb) / np.maximum(np.maximum(wa, wb), 1), 0.0))
    same = pd.factorize(np.concatenate((col(a, "canonical"), col(b, "canonical"))))[0]
    x, y = same[: len(a), None], same[None, len(a) :]
    name = np.where((x == y) & (x >= 0), np.maximum(name, SAME), name)
    near = col(a, "known")[:, None] & col(b, "known")[None, :] & ((col(a, "places")[:, None] & col(b, "places")[None, :]) != 0)
    return np.where(near, np.maximum(name, weights["name"] * name + weights["place"]), name)


def _hopeful(a: DataFrame, b: DataFrame, weights: dict, first: int | None) -> DataFrame:
    """(a, b) of pairs of profiles: the ``first`` highest bounds of each form in each tile, or all that reach ``bound``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == "a"], pdf[pdf["side"] == "b"]
        none = pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
        if not len(left) or not len(right):
            return none
        found, other = [], right["id"].to_numpy()
        # slices of the left side bound the matrices of characters
        for begin in range(0, len(left), 500):
            part = left.iloc[begin : begin + 500]
            most = bounds(part, right, weights)
            if first is None:
                i, j = np.nonzero((most >= part["bound"].to_numpy()[:, None] - 1e-9) & (most > 0))
            else:
                k = min(first, len(right))
                j = np.argpartition(-most, k - 1, axis=1)[:, :k].ravel()
                i = np.repeat(np.arange(len(part)), k)
            found.append(pd.DataFrame({"a": part["id"].to_numpy()[i], "b": other[j]}).drop_duplicates())
        return pd.concat([none, *found])

    names = [x.split()[0] for x in FORM.split(", ")]
    if "bound" not in a.columns:
        a = a.withColumn("bound", F.lit(0.0))
    side = lambda d, s: d.withColumn("side", F.lit(s)).select(names)
    rows = side(a, "a").unionByName(side(b.withColumn("bound", F.lit(0.0)), "b"))
    return rows.groupBy("tile").applyInPandas(run, "a bigint, b bigint").distinct()


def _scored(pairs: DataFrame, a: DataFrame, b: DataFrame, index: DataFrame, weights: dict) -> DataFrame:
    """(a, b, alias_score, score) of pairs of profiles."""
    side = lambda d, x: d.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("name", "f", "p", "c", "canonical")])
    both = pairs.join(side(a, "a"), "a").join(side(b, "b"), "b")
    names = both.select("name_a", "name_b", F.col("canonical_a").alias("_ca"), F.col("canonical_b").alias("_cb")).distinct()
    named = both.join(league_rules.alias_scores(names, "name_a", "name_b", index), ["name_a", "name_b"])
    c = F.col
    away = (geo.forms_veto(c("p_a"), c("p_b")) | geo.forms_veto_by_name(c("c_a"), c("p_b"))) if weights["veto"] else F.lit(False)
    named = named.withColumn("_geo", geo.forms_geo_similarity(c("p_a"), c("p_b"))).withColumn("_away", away)
    score = league_rules.prepared_score(c("alias_score"), c("f_a"), c("f_b"), c("_geo"), c("p_a.known") & c("p_b.known"), c("_away"), weights)
    return named.select("a", "b", "alias_score", score.alias("score"))


def scored_candidates(named: DataFrame, candidates: DataFrame, index: DataFrame, weights: dict, least: float, k: int) -> DataFrame:
    """Scored pairs of leagues (id, sport, league_name, category_name) and candidates, the k best of each league among them.

    The columns are those of both sides, alias_score and score.
    """
    a, b = _profiles(named, "league_name", "category_name", index), _profiles(candidates, "competition_name", "country", index)
    tiled_a, tiled_b = (cut(d) for d in _tiles(_forms(a, index), _forms(b, index)))
    key = lambda name, place: F.xxhash64("sport", F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(place), F.lit("")))
    numbered = candidates.withColumn("b", key("competition_name", "country"))
    by_seq = lambda *keys: Window.partitionBy(*keys).orderBy("candidate_seq")
    first = numbered.withColumn("_n", F.row_number().over(by_seq("sport"))).filter(F.col("_n") <= k).select("sport", "b").distinct()
    zero = a.select("sport", F.col("id").alias("a")).join(first, "sport").select("a", "b")  # k rows a league
    tried = cut(_hopeful(tiled_a, tiled_b, weights, k + FIRST).unionByName(zero).distinct())
    scored = cut(_scored(tried, a, b, index, weights))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))).filter(F.col("_n") <= k)
    reached = best.groupBy("a").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("_reached"))
    measured = tiled_a.join(reached, F.col("id") == F.col("a"), "left").withColumn("bound", F.greatest(F.coalesce("_reached", F.lit(0.0)), F.lit(float(least)))).drop("a", "_reached")
    others = cut(_hopeful(measured, tiled_b, weights, None).join(tried, ["a", "b"], "left_anti"))
    every = scored if others.isEmpty() else scored.unionByName(_scored(others, a, b, index, weights))
    # of candidates with one name and place the first k are enough
    some = numbered.withColumn("_n", F.row_number().over(by_seq("b"))).filter(F.col("_n") <= k).drop("_n", "sport")
    return named.withColumn("a", key("league_name", "category_name")).join(every, "a").join(some, "b").drop("a", "b")
