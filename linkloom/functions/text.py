"""Names: normal forms and similarity.

Everything is a built-in column expression except two Arrow functions for what Spark has no built-in: Jaro similarity
and the sequence ratio. Give those distinct pairs, not raw rows.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import cache, partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, kernels


def literal(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def whole_word(text: str) -> str:
    """A case-insensitive pattern with ASCII word boundaries."""
    return rf"(?i)(?<![0-9A-Za-z_]){literal(text)}(?![0-9A-Za-z_])"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated outside any lambda, and once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@cache
def _marks() -> tuple[str, str]:
    """Characters with a mark and the characters under it; the marks themselves follow, without a counterpart."""
    marked, plain, marks = [], [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        base = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != ch:
            marked.append(ch)
            plain.append(base[0])
    return "".join(marked + marks), "".join(plain)


def strip_marks(name: Column) -> Column:
    """Canonical decomposition without combining marks, by one lookup a character."""
    return F.translate(name, *_marks())


def _spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(name: Column) -> Column:
    """Folded, lower case, ``· . - _ ,`` as spaces, quotes gone, single spaces (F1)."""
    return _clean(strip_marks(F.coalesce(name, F.lit(""))))


def _clean(folded: Column) -> Column:
    return _spaces(F.translate(F.lower(folded), "·.-_,'\"", "     "))


def token_set(norm: Column) -> Column:
    """Distinct words of a normalised name; none for the empty name (F2)."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets: 1 if both are empty, 0 if one is."""

    def share(s: Column) -> Column:
        both = F.size(F.array_union(s["a"], s["b"]))
        return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(both, F.lit(1)))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def name_jaccard(a: Column, b: Column) -> Column:
    return jaccard(token_set(normalize_name(a)), token_set(normalize_name(b)))


def name_candidates(norm: Column) -> Column:
    """The name, its words sorted, first and last word as they stand and sorted, and the words reversed."""
    words = F.filter(F.split(norm, " "), lambda x: x != "")
    ends = F.array(F.element_at(words, 1), F.element_at(words, -1))
    join = lambda a: F.array_join(a, " ")
    long = F.size(words) > 2
    forms = F.array(norm, join(F.array_sort(words)), F.when(long, join(ends)), F.when(long, join(F.array_sort(ends))), join(F.reverse(words)))
    return F.array_distinct(F.array_compact(forms))


def player_similarity(a: Column, b: Column) -> Column:
    """The best Jaccard similarity over all pairs of candidate forms (F5); word order does not matter to it."""

    def best(s: Column) -> Column:
        every = F.transform(s["x"], lambda p: F.transform(s["y"], lambda q: jaccard(token_set(p), token_set(q))))
        return F.array_max(F.flatten(every))

    forms = lambda c: let(normalize_name(c), name_candidates)
    return let(F.struct(forms(a).alias("x"), forms(b).alias("y")), best)


def _batched(kernel, a: pd.Series, b: pd.Series) -> pd.Series:
    """``kernel`` on the distinct pairs of two columns; null where either side is."""
    pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()})
    number = pairs.groupby(["a", "b"], sort=False, dropna=True).ngroup().to_numpy()
    known = np.flatnonzero(number >= 0)
    _, first, back = np.unique(number[known], return_index=True, return_inverse=True)
    out = np.full(len(pairs), np.nan)
    if len(known):
        at = known[first]
        out[known] = kernel(pairs["a"].iloc[at].tolist(), pairs["b"].iloc[at].tolist())[back]
    return pd.Series(out).astype("Float64").where(number >= 0)


def _pairwise(f, a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = None if None in pair else f(*pair)
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype="float64")


def _jaro_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return _batched(kernels.jaro, a, b)


def _whole_jaro_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return _batched(partial(kernels.jaro, whole=True), a, b)


def _ratio_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio(), a, b)


def jaro(a: Column, b: Column, whole: bool = False) -> Column:
    """Jaro similarity over code points (F6); an odd character out of place counts half a transposition, or none if ``whole``."""
    return F.pandas_udf(_whole_jaro_all if whole else _jaro_all, "double")(a, b)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks."""
    return F.pandas_udf(_ratio_all, "double")(a, b)


def _winkler_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return _batched(kernels.winkler, a, b)


def _whole_winkler_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return _batched(partial(kernels.winkler, whole=True), a, b)


def _strong_winkler_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return _winkler_all(a, b).where(lambda v: v.isna() | (v >= 0.75), 0.0)


def jaro_winkler(a: Column, b: Column, whole: bool = False) -> Column:
    """Jaro raised by 0.1 a shared leading character, up to four, whatever the Jaro score."""
    return F.pandas_udf(_whole_winkler_all if whole else _winkler_all, "double")(a, b)


def name_similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard and Jaro-Winkler of the normalised names (F8)."""
    x, y = normalize_name(a), normalize_name(b)
    return F.greatest(jaccard(token_set(x), token_set(y)), jaro_winkler(x, y))


def strip_words(name: Column, words: list[str]) -> Column:
    """Words taken out one after the other; a name that would become empty stays."""

    def strip(given: Column) -> Column:
        gone = _spaces(reduce(lambda c, w: F.regexp_replace(c, whole_word(w), " "), words, given))
        return let(gone, lambda g: F.when(g == "", given).otherwise(g))

    return let(name, strip)


def translate_words(name: Column) -> Column:
    return reduce(lambda c, kv: F.regexp_replace(c, whole_word(kv[0]), kv[1]), fixed.LANGUAGE_ALIASES.items(), name)


def _team_form(folded: Column, given: Column, sponsors: bool = False) -> Column:
    c = F.regexp_replace(folded, "[&/]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\.", ""), r"(?i)\bsaint-", "Saint ")
    c = translate_words(F.regexp_replace(c, r"^\s*[0-9]+\s*", ""))
    if sponsors:
        c = strip_words(c, fixed.SPONSORS)
    c = strip_words(_spaces(c), fixed.CLUB_TYPES)
    c = _spaces(F.lower(F.regexp_replace(c, r"(?i)oe(?![0-9A-Za-z_])", "o")))
    return let(c, lambda n: F.when(n == "", F.lower(given)).otherwise(n))


def normalize_team_name(name: Column, sponsors: bool = False) -> Column:
    """A club's name without marks, numbers, club-type letters and (optionally) sponsors, lower case."""
    given = F.coalesce(name, F.lit(""))
    return let(strip_marks(given), lambda s: _team_form(s, given, sponsors))


def team_forms(name: Column) -> Column:
    """struct(words, norm, norm_words): what team similarity needs of a name, to be computed once a name."""
    given = F.coalesce(name, F.lit(""))

    def forms(s: Column) -> Column:
        norm = _team_form(s, given)
        return let(norm, lambda n: F.struct(token_set(_clean(s)).alias("words"), n.alias("norm"), token_set(_clean(n)).alias("norm_words")))

    return let(strip_marks(given), forms)


def forms_similarity(x: Column, y: Column) -> Column:
    """Best of Jaccard, Jaccard of the team forms, and Jaro-Winkler of those where it is 0.75 or more.

    ``x`` and ``y`` are columns that hold forms already: an Arrow function takes no expression with lambdas.
    """
    strong = F.pandas_udf(_strong_winkler_all, "double")(x["norm"], y["norm"])
    return F.greatest(jaccard(x["words"], y["words"]), jaccard(x["norm_words"], y["norm_words"]), strong)


def normalize_league_name(name: Column) -> Column:
    """F1, brackets as spaces, without year tokens such as 2026 or 25/26."""
    words = F.split(F.translate(normalize_name(name), "()[]", "    "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~is_year_token(w)), " ")


def is_year_token(word: Column) -> Column:
    return word.rlike(r"^([0-9]{4}|[0-9]+/[0-9]+)$")


def is_placeholder(name: Column) -> Column:
    """A slot in a schedule rather than a team."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return reduce(lambda a, b: a | b, [n.startswith(p) for p in fixed.PLACEHOLDERS])


def offline_normalize(name: Column, strip_clubs: bool = False) -> Column:
    """The offline tools' normal form: quotes are spaces; optionally without brackets and short club types."""
    c = F.translate(F.lower(strip_marks(F.coalesce(name, F.lit("")))), "·.-_,'\"|", "        ")
    if strip_clubs:
        c = F.regexp_replace(F.translate(c, "()[]", "    "), r"\b(fc|sc|ac|fk|sk)\b", " ")
    return _spaces(c)


def offline_similarity(a: Column, b: Column, strip_clubs: bool = False) -> Column:
    """The better of Jaccard and sequence ratio of the normal forms; 1 for two empty names, 0 for one."""
    x, y = offline_normalize(a, strip_clubs), offline_normalize(b, strip_clubs)
    parts = [jaccard(token_set(x), token_set(y)), sequence_ratio(x, y), *([jaro_winkler(x, y)] if strip_clubs else [])]
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(F.greatest(*parts))


def virtual_reason(name: Column) -> Column:
    """Why a league's name says it is played on a screen; null if it is not."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.when(n == "", None)
    for pattern, reason in fixed.VIRTUAL:
        out = out.when(n.rlike(pattern), reason)
    out = out.when(n.rlike(fixed.VIRTUAL_TIMES) & n.contains("futsal"), None)
    return out.when(n.rlike(fixed.VIRTUAL_TIMES), "minutes").when(n.rlike(fixed.VIRTUAL_TIMES_MORE), "minutes")


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def normalize_prior(*scores: Column) -> Column:
    """Mean of the positive scores, at most 1; 0 without any."""
    good = F.filter(F.array(*scores), lambda x: x > 0)
    total = F.aggregate(good, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(good) > 0, F.least(F.lit(1.0), total / F.size(good))).otherwise(0.0)
