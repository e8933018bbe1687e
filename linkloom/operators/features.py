"""What a league's name says about it, and what may not match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, literal, normalize_name


def keyword_pattern(words: list[str]) -> str:
    return "|".join(literal(w) for w in words)


def _any(norm: Column, words: list[str]) -> Column:
    return norm.rlike(keyword_pattern(words))


def _whole(norm: Column, words: list[str]) -> Column:
    """The first occurrence of a word stands alone (a later one is not looked at)."""
    first = lambda w: rf"^(?:(?!{w})[\s\S])*(?<![^ ]){w}(?![^ ])"
    return norm.rlike("|".join(first(literal(w)) for w in words))


def _ladder(norm: Column, table: dict[str, list[str]], test=_any) -> Column:
    return reduce(lambda c, kv: c.when(test(norm, kv[1]), kv[0]), table.items(), F.when(F.lit(False), "")).otherwise("")


def gender(norm: Column) -> Column:
    alone = lambda w: rf"(?<![^ ]){literal(w)}(?![^ ])"
    men = "|".join(alone(w) if w in fixed.MEN_WHOLE else literal(w) for w in fixed.MEN)
    return F.when(_any(norm, fixed.WOMEN), "women").when(norm.rlike(men), "men").otherwise("")


def age_group(norm: Column) -> Column:
    return _ladder(norm, fixed.AGES)


def region(norm: Column) -> Column:
    return _ladder(norm, fixed.REGIONS, _whole)


def competition_type(norm: Column) -> Column:
    return _ladder(norm, fixed.COMPETITIONS)


def tier(norm: Column) -> Column:
    """struct(number, roman): the first pattern with a number from 1 to 10, a series letter or a Roman numeral."""
    tries = []
    for p in fixed.TIER_PATTERNS:
        got = F.regexp_extract(norm, rf"(?<![0-9A-Za-z_]){p}(?![0-9A-Za-z_])", 1)
        n = got.try_cast("int")
        letter = F.when(got.rlike("^[a-e]$"), F.ascii(got) - 96)
        tries.append(F.coalesce(F.when(n.between(1, 10), n), letter))
    words = sorted(fixed.ORDINAL_TIERS.items(), key=lambda p: (-len(p[0]), p[0]))
    by_word = reduce(lambda c, p: c.when(norm.contains(p[0]), p[1]), words, F.when(F.lit(False), 0))
    roman = F.regexp_extract(norm, fixed.LONE_ROMAN, 1)
    by_roman = reduce(lambda c, kv: c.when(roman == kv[0], kv[1]), fixed.ROMAN.items(), F.when(F.lit(False), 0))
    plain = F.coalesce(*tries, by_word)
    return F.struct(F.coalesce(plain, by_roman, F.lit(0)).alias("number"), F.when(plain.isNull(), F.coalesce(roman, F.lit(""))).otherwise("").alias("roman"))


def league_features(name: Column) -> Column:
    """struct(gender, age_group, region, comp_type, tier_number, tier_roman, norm_name) of a league's name (L1)."""

    def read(n: Column) -> Column:
        kinds = F.struct(gender(n).alias("gender"), age_group(n).alias("age_group"), region(n).alias("region"), competition_type(n).alias("comp_type"), tier(n).alias("t"), n.alias("norm_name"))
        flat = lambda k: F.struct(
            k["gender"].alias("gender"),
            k["age_group"].alias("age_group"),
            k["region"].alias("region"),
            k["comp_type"].alias("comp_type"),
            k["t"]["number"].alias("tier_number"),
            k["t"]["roman"].alias("tier_roman"),
            k["norm_name"].alias("norm_name"),
        )
        return let(kinds, flat)

    return let(normalize_name(name), read)


def league_veto(a: Column, b: Column) -> Column:
    """The reason why two leagues (feature structs) cannot be one; null if nothing speaks against it."""
    one_sided = lambda f: a[f] != b[f]  # noqa: E731  present on one side only, or different on both
    x, y = a["comp_type"], b["comp_type"]
    cups, leagues = ("cup", "super_cup"), ("league",)
    mains = ("league", "cup", "super_cup", "regional_league")
    either = lambda p, q: (x.isin(*p) & y.isin(*q)) | (y.isin(*p) & x.isin(*q))
    only = lambda kind: (x == kind) != (y == kind)
    women = (a["gender"] == "women") != (b["gender"] == "women")
    return (
        F.when(women, "gender_conflict")
        .when(one_sided("age_group"), "age_conflict")
        .when(one_sided("region"), "region_conflict")
        .when(only("short_format"), "short_format_conflict")
        .when(either(cups, leagues) | either(("reserve",), mains) | either(("regional_league",), leagues) | only("draft") | only("all_star"), "competition_type_conflict")
        .when((a["tier_number"] > 0) & (b["tier_number"] > 0) & (a["tier_number"] != b["tier_number"]), "tier_number_conflict")
    )


def feature_penalty(a: Column, b: Column) -> Column:
    """A factor for leagues that differ without a veto."""
    both = lambda f: (a[f] != "") & (b[f] != "") & (a[f] != b[f])
    half = lambda kind: ((a["comp_type"] == kind) & (b["comp_type"] == "")) | ((b["comp_type"] == kind) & (a["comp_type"] == ""))
    return (
        F.when(both("gender"), 0.0).otherwise(1.0)
        * F.when(both("age_group"), 0.3).otherwise(1.0)
        * F.when(half("reserve"), 0.5).otherwise(1.0)
        * F.when(half("regional_league"), 0.7).otherwise(1.0)
    )
