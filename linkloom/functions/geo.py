"""Places (F13-F16, F27, F29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import jaccard, let, normalize_name, token_set


def place_group(norm: Column) -> Column:
    """Number of the group of names that a normalised place belongs to; null outside all."""
    first = {name: number for number, names in reversed(list(enumerate(fixed.PLACE_GROUPS))) for name in names}
    return F.try_element_at(table(first), norm)


def quoted(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table(entries: dict) -> Column:
    """A constant map, parsed from one expression: an expression tree of thousands of parts is slow to make one by one."""
    return F.expr(f"map({', '.join(quoted(x) for kv in entries.items() for x in kv)})")


def geo_similarity(a: Column, b: Column) -> Column:
    """1 for equal places or names of one place, else Jaccard similarity."""

    def alike(s: Column) -> Column:
        x, y = s["x"], s["y"]
        return F.when((x == y) | (place_group(x) == place_group(y)), 1.0).otherwise(jaccard(token_set(x), token_set(y)))

    return let(F.struct(normalize_name(a).alias("x"), normalize_name(b).alias("y")), alike)


def place_form(place: Column) -> Column:
    """struct(norm, words, group, known, world): what comparing places needs of one, to be computed once a place."""

    def form(n: Column) -> Column:
        words = token_set(n)
        world = (F.size(words) == 1) & F.coalesce(F.get(words, 0).isin(fixed.INTERNATIONAL), F.lit(False))
        return F.struct(n.alias("norm"), words.alias("words"), place_group(n).alias("group"), (F.coalesce(place, F.lit("")) != "").alias("known"), world.alias("world"))

    return let(normalize_name(F.coalesce(place, F.lit(""))), form)


def forms_geo_similarity(x: Column, y: Column) -> Column:
    """:func:`geo_similarity` of two place forms."""
    return F.when((x["norm"] == y["norm"]) | F.coalesce(x["group"] == y["group"], F.lit(False)), 1.0).otherwise(jaccard(x["words"], y["words"]))


def forms_veto(x: Column, y: Column) -> Column:
    """:func:`location_veto` of two place forms."""
    return x["known"] & y["known"] & ~x["world"] & ~y["world"] & (forms_geo_similarity(x, y) < 0.4)


def forms_veto_by_name(country: Column, y: Column) -> Column:
    """:func:`location_veto_by_name` of the form of a league's country and a place form."""
    return (country["norm"] != "") & (y["norm"] != "") & ~y["world"] & (forms_geo_similarity(country, y) < 0.4)


def is_international(place: Column) -> Column:
    """A keyword, or as good as one (F14): a set of words has Jaccard 0.8 or more with a single word only if it is that word."""
    one = lambda words: (F.size(words) == 1) & F.get(words, 0).isin(fixed.INTERNATIONAL)
    return F.coalesce(let(token_set(normalize_name(place)), one), F.lit(False))


def location_veto(a: Column, b: Column) -> Column:
    """Two known national places that differ."""
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return known & ~is_international(a) & ~is_international(b) & (geo_similarity(a, b) < 0.4)


def country_of_league(norm: Column, whole_word: bool = False) -> Column:
    """The country that a league's normalised name gives away, longest abbreviation first; '' if none does (F16)."""
    pairs = sorted(fixed.ABBREVIATIONS.items(), key=lambda p: (-len(p[0]), p[0]))

    def look(n: Column) -> Column:
        padded = F.concat(F.lit(" "), n, F.lit(" "))
        there = lambda a: padded.contains(F.concat(F.lit(" "), a, F.lit(" "))) if whole_word else n.contains(a)
        names = F.expr(f"array({', '.join(quoted(abbr) for abbr, _ in pairs)})")
        return F.coalesce(F.try_element_at(table(dict(pairs)), F.get(F.filter(names, there), 0)), F.lit(""))

    return let(norm, look)


def location_veto_by_name(league: Column, place: Column, whole_word: bool = False) -> Column:
    """A league whose name gives a country away, against a known national place that differs (F16)."""
    country = country_of_league(normalize_name(league), whole_word)
    parts = F.struct(country.alias("c"), normalize_name(place).alias("p"))

    def differ(s: Column) -> Column:
        words = token_set(s["p"])
        world = (F.size(words) == 1) & F.coalesce(F.get(words, 0).isin(fixed.INTERNATIONAL), F.lit(False))
        same = F.when((s["c"] == s["p"]) | (place_group(s["c"]) == place_group(s["p"])), 1.0).otherwise(jaccard(token_set(s["c"]), words))
        return (s["c"] != "") & (s["p"] != "") & ~world & (same < 0.4)

    return let(parts, differ)


def country_code_veto(a: Column, b: Column) -> Column:
    """Two known country codes that differ, unless one is international."""
    x, y = F.upper(F.coalesce(a, F.lit(""))), F.upper(F.coalesce(b, F.lit("")))
    world = ("INT", "EUR", "WOR", "ASI", "AFR")
    return (x != "") & (y != "") & ~x.isin(*world) & ~y.isin(*world) & (x != y)


def location_score(a: Column, code_a: Column, b: Column, code_b: Column) -> Column:
    """struct(score, exact): 1 and exact for equal country codes, 0.1 for known codes that differ, else Jaccard of the places."""

    def judged(s: Column) -> Column:
        coded = (s["x"] != "") & (s["y"] != "")
        named = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
        score = F.when(coded & (s["x"] == s["y"]), 1.0).when(coded, 0.1).when(named, jaccard(token_set(s["p"]), token_set(s["q"]))).otherwise(0.0)
        return F.struct(score.alias("score"), (coded & (s["x"] == s["y"])).alias("exact"))

    code = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return let(F.struct(code(code_a).alias("x"), code(code_b).alias("y"), normalize_name(a).alias("p"), normalize_name(b).alias("q")), judged)


def extract_country(name: Column, countries: dict[str, str]) -> Column:
    """The country named by the longest of the first three, two or one words of a league's name."""
    words = F.filter(F.split(normalize_name(name), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in countries.items() for x in kv]) if countries else None
    if table is None:
        return F.lit("")
    heads = [F.when(F.size(words) >= n, F.try_element_at(table, F.array_join(F.slice(words, 1, n), " "))) for n in (3, 2, 1)]
    return F.coalesce(*heads, F.lit(""))
