"""Event matching inside a league.

Assignments depend on the order of source events and on aliases learned on the way, so the full matcher is a kernel that
runs per league or, where a league is large, per segment of it until all segments agree (:mod:`.segments`). What can be
shared out is done before it: names are compared once per distinct pair of team names of a league, distributed. The
stateless forms (best by tier, unique candidate, id pair, placeholder) are joins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import forms_similarity, is_placeholder, offline_similarity, team_forms
from ..functions.timing import gaussian_time, round3, utc_day
from .blocking import time_window_join
from . import segments
from .lineage import cut

L5_GAP, L5_NAME = 30 * 86400, 0.90
L6_GAP, L6_CONFIDENCE = 300, 0.70
ALIAS_LEARN, ALIAS_SCORE = 0.50, 0.92
#: Begins the key of a team without an id.
NAMED = "\x01"
RESULT = (
    "league_id string, event_id string, target_id string, rule string, confidence double, time_diff bigint, matched boolean, "
    "home_id string, away_id string, target_home_id string, target_away_id string"
)
#: The widest gap of the levels that compare names around an event, and the least similarity of both sides at L5.
REACH, FAR_NAME = 3 * 86400, 2 * L5_NAME - 1
#: Parts that the target teams of a league are dealt into when teams are paired.
TEAM_TILES = 32
#: One UTC day's worth of seconds is the widest gap that the tiers without an alias allow.
DAY = 86400


class Aliases:
    """Team ids learned to be the same, by votes."""

    def __init__(self, to: dict[str, str] | None = None, back: dict[str, str] | None = None):
        self.votes: dict = defaultdict(int)
        self.to: dict[str, str] = dict(to or {})
        self.back: dict[str, str] = dict(back or {})
        self.log: list[tuple[str, str]] = []

    def learn(self, source: tuple[str, str], target: tuple[str, str], sim) -> None:
        (h, a), (th, ta) = source, target
        straight = sim(h, th) + sim(a, ta)
        if straight / 2 < ALIAS_LEARN:
            return
        crossed = sim(h, ta) + sim(a, th)
        for s, t in ((h, th), (a, ta)) if straight >= crossed else ((h, ta), (a, th)):
            if s and t:
                self.votes[s, t] += 1
                self.to[s], self.back[t] = t, s
                self.log.append((s, t))

    def score(self, s: str, t: str, sim) -> float:
        if s and t and (self.to.get(s) == t or self.back.get(t) == s):
            return ALIAS_SCORE
        return sim(s, t)

    def hit(self, s: str, targets: tuple[str, str]) -> bool:
        return s in self.to and self.to[s] in targets


def _round(x: float) -> float:
    return float(np.floor(abs(x) * 1000 + 0.5) / 1000 * np.sign(x))


def match_league(source: pd.DataFrame, target: pd.DataFrame, sims: dict, team_map: dict[str, str], known: Aliases | None = None) -> list[tuple]:
    """One league, or a segment of it that begins with the aliases ``known``: source events in order, each takes the best free target of the first level that has one.

    ``source`` and ``target`` have id, start, home, away (team ids) and, for the source, ``slot`` (both names are
    placeholders). Targets are sorted by time, so that a level looks at its window only; equal scores go to the first.
    """
    source = source.sort_values(["start", "id"], kind="stable")
    target = target.sort_values(["start", "id"], kind="stable").reset_index(drop=True)
    times = target["start"].to_numpy()
    teams = list(zip(target["home"], target["away"], strict=True))
    free = np.ones(len(target), dtype=bool)
    by_pair: dict = defaultdict(list)
    for j, pair in enumerate(teams):
        by_pair[pair].append(j)
    untimed = np.flatnonzero(times == 0)
    known = known if known is not None else Aliases()
    sim = lambda a, b: sims.get((a, b), 0.0)

    def window(low: int, high: int) -> np.ndarray:
        at = np.arange(np.searchsorted(times, low, "left"), np.searchsorted(times, high, "right"))
        return at[free[at]]

    def name(e, j: int) -> float:
        return (known.score(e.home, teams[j][0], sim) + known.score(e.away, teams[j][1], sim)) / 2

    def tiers(e):
        for rule, sigma, gap, least_name, w_time, w_name, least, alias in fixed.EVENT_LEVELS:
            if gap is None:
                day = e.start // DAY * DAY
                found = window(day, day + DAY - 1)
            else:
                found = window(e.start - gap, e.start + gap)
            best, at = -1.0, -1
            for j in found.tolist():
                if alias and not (known.hit(e.home, teams[j]) or known.hit(e.away, teams[j])):
                    continue
                n = name(e, j)
                if n < least_name:
                    continue
                near = np.exp(-((e.start - times[j]) ** 2) / (2.0 * sigma * sigma)) if w_time and sigma else 0.0
                score = w_time * near + w_name * n
                if score >= least and score > best:
                    best, at = score, j
            if at >= 0:
                return rule, at, best
        return None

    def alone(e):
        found = np.union1d(window(e.start - L5_GAP, e.start + L5_GAP), untimed[free[untimed]])
        good = [(j, n) for j in found.tolist() if (n := name(e, j)) >= L5_NAME]
        return ("EVENT_L5", *good[0]) if len(good) == 1 else None

    def by_ids(e):
        best, at = -1.0, -1
        for j in by_pair.get((team_map.get(e.home), team_map.get(e.away)), []) if e.home in team_map and e.away in team_map else []:
            score = 0.75 + 0.10 * np.exp(-((e.start - times[j]) ** 2) / (2.0 * 3600 * 3600))
            if free[j] and score > best:
                best, at = score, j
        return ("EVENT_L4B", at, best) if at >= 0 else None

    def slot(e):
        found = window(e.start - L6_GAP, e.start + L6_GAP) if e.slot else []
        return ("EVENT_L6", int(found[0]), L6_CONFIDENCE) if len(found) == 1 else None

    out = []
    for e in source.itertuples(index=False):
        hit = tiers(e)
        if hit:
            known.learn((e.home, e.away), teams[hit[1]], sim)
        hit = hit or alone(e) or by_ids(e) or slot(e)
        if hit is None:
            out.append((e.id, "", "EVENT_NO_MATCH", 0.0, 0, False, e.home, e.away, "", "", None))
            continue
        rule, j, score = hit
        free[j] = False
        out.append((e.id, target["id"][j], rule, _round(score), int(abs(e.start - times[j])), True, e.home, e.away, *teams[j], int(times[j])))
    return out


def team_key(side: str) -> Column:
    """What a team goes by in a league: its id or, without one, its name."""
    team = F.coalesce(F.col(f"{side}_id").cast("string"), F.lit(""))
    return F.when(team != "", team).otherwise(F.concat(F.lit(NAMED), F.coalesce(F.col(f"{side}_name"), F.lit(""))))


def _id_of(key: str) -> Column:
    return F.when(F.col(key).startswith(NAMED), "").otherwise(F.col(key)).alias(key)


def team_name(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_name"), F.lit(""))


def team_pairs(source: DataFrame, target: DataFrame, scores: Callable[[DataFrame], DataFrame] | None = None, key: Callable[[str], Column] = team_key) -> DataFrame:
    """(league_id, s, t, sim): name similarity of each distinct (source team, target team) of a league, by their keys."""
    side = lambda x: F.struct(key(x).alias("t"), team_name(x).alias("n"))
    teams = lambda d: d.select("league_id", F.explode(F.array(side("home"), side("away"))).alias("x")).select("league_id", "x.t", "x.n").distinct()
    a, b = teams(source).toDF("league_id", "s", "sn"), teams(target).toDF("league_id", "t", "tn")
    # a league with many teams is dealt over several join keys
    tiles = F.explode(F.sequence(F.lit(0), F.lit(TEAM_TILES - 1)))
    pairs = a.withColumn("_tile", tiles).join(b.withColumn("_tile", F.pmod(F.xxhash64("t"), F.lit(TEAM_TILES)).cast("int")), ["league_id", "_tile"]).drop("_tile")
    scored = (scores or name_pair_scores)(pairs.select(F.col("sn").alias("x"), F.col("tn").alias("y"))).toDF("sn", "tn", "sim")
    return pairs.join(scored, ["sn", "tn"]).groupBy("league_id", "s", "t").agg(F.max("sim").alias("sim"))


def offline_pair_scores(pairs: DataFrame) -> DataFrame:
    """(x, y, sim) of the distinct pairs of names, by the offline tools' similarity."""
    pairs = pairs.distinct()
    return pairs.select("x", "y", offline_similarity(F.col("x"), F.col("y")).alias("sim"))


def name_pair_scores(pairs: DataFrame) -> DataFrame:
    """(x, y, sim) of the distinct pairs (x, y) of names: each name is brought into its forms once, each pair compared once."""
    pairs = pairs.distinct()
    names = pairs.select(F.col("x").alias("n")).unionByName(pairs.select(F.col("y").alias("n"))).distinct()
    forms = names.repartition("n").withColumn("f", team_forms(F.col("n")))
    both = pairs.join(forms.toDF("x", "fx"), "x").join(forms.toDF("y", "fy"), "y")
    return both.select("x", "y", forms_similarity(F.col("fx"), F.col("fy")).alias("sim"))


def _columns(pdf: pd.DataFrame, kind: str, *names: str) -> list:
    rows = pdf[pdf["kind"] == kind]
    return list(zip(*[rows[n] for n in names], strict=True))


def _cell_events(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, dict]:
    """Source events and free targets of a cell, in order, and the similarities of their teams."""
    gone = pd.MultiIndex.from_tuples(_columns(pdf, "x", "id", "start", "home", "away"), names=["id", "start", "home", "away"])
    target = pdf[pdf["kind"] == "t"].drop_duplicates(["id", "start", "home", "away"])
    target = target[~pd.MultiIndex.from_frame(target[["id", "start", "home", "away"]]).isin(gone)].astype({"start": "int64"})
    source = pdf[pdf["kind"] == "s"].astype({"start": "int64", "slot": "bool"})
    sims = {(h, a): v for h, a, v in _columns(pdf, "p", "home", "away", "sim")}
    order = lambda d: d.sort_values(["start", "id", "home", "away"], kind="stable")
    return order(source), order(target), sims


def _out(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in segments.OUT.split(", ")]).astype({"target_start": "Int64"})


def _event_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ordered matcher on one cell of :mod:`.segments`."""
    place = (pdf["league_id"].iloc[0], int(pdf["seg"].iloc[0]))
    source, target, sims = _cell_events(pdf)
    known = Aliases(dict(_columns(pdf, "a", "home", "away")), {t: s for s, t in _columns(pdf, "b", "home", "away")})
    rows = match_league(source, target, sims, dict(_columns(pdf, "m", "home", "away")), known)
    out = [(*place, "r", n, *r) for n, r in enumerate(rows)]
    return _out(out + [(*place, "l", n, "", "", "", 0.0, 0, False, s, "", t, "", None) for n, (s, t) in enumerate(known.log)])


def match_events(source: DataFrame, target: DataFrame, team_map: DataFrame | None = None, size: int = segments.SEGMENT) -> DataFrame:
    """All leagues at once (E1-E7): canonical events with ``league_id``; ``team_map`` has (league_id, s, t).

    Leagues of more than ``size`` source events are matched by segments, with the result of one ordered pass. Target rows
    that repeat in id, time and teams are one target.
    """
    return matches_of(match_rows(source, target, team_map, size))


def matches_of(rows: DataFrame) -> DataFrame:
    """The matches among the rows of :func:`match_rows`, teams without an id as such."""
    keys = ("home_id", "away_id", "target_home_id", "target_away_id")
    names = [x.split()[0] for x in RESULT.split(", ")]
    return rows.filter("kind = 'r'").select(*[_id_of(c) if c in keys else F.col(c) for c in names])


def match_rows(source: DataFrame, target: DataFrame, team_map: DataFrame | None = None, size: int = segments.SEGMENT, before: DataFrame | None = None) -> DataFrame:
    """Matches and learned aliases in order (:data:`.segments.OUT`).

    ``before`` has such rows of earlier source events, with ``batch`` to order them by: their targets are gone, and their
    aliases are known.
    """
    s = segments.event_rows(source, "s", team_key("home"), team_key("away"), is_placeholder(F.col("home_name")) & is_placeholder(F.col("away_name")))
    t = segments.event_rows(target, "t", team_key("home"), team_key("away")).distinct()
    sims = team_pairs(source, target)
    maps = None if team_map is None else team_map.select("league_id", "s", "t").distinct()
    prior = None
    if before is not None:
        gone = before.filter("kind = 'r' and matched").select("league_id", F.col("target_id").alias("id"), F.col("target_start").alias("start"), F.col("target_home_id").alias("home"), F.col("target_away_id").alias("away")).distinct()  # noqa: E501
        t = t.join(gone, ["league_id", "id", "start", "home", "away"], "left_anti")
        taught = segments.aliases_of(before.withColumn("n", (F.col("batch") * F.lit(1 << 40) + F.col("n")).cast("long")))
        # segments of one batch follow each other; within a league their order and n's give one order
        order = F.row_number().over(Window.partitionBy("league_id").orderBy(F.shiftright("n", 40), "seg", "n"))
        prior = cut(taught.withColumn("n", order.cast("long")).withColumn("seg", F.lit(0).cast("long")))
    large = cut(segments.large_leagues(s, t, size))
    split = not large.isEmpty()
    rest = (lambda d: d.join(large, "league_id", "left_anti")) if split else (lambda d: d)
    cell = segments.cell
    event = dict(id="id", start="start", home="home", away="away", slot="slot")
    first = lambda d: d.withColumn("seg", F.lit(0))
    whole = cell(first(rest(s)), "s", **event).unionByName(cell(first(rest(t)), "t", **event)).unionByName(cell(first(rest(sims)), "p", home="s", away="t", sim="sim"))
    if maps is not None:
        whole = whole.unionByName(cell(first(rest(maps)), "m", home="s", away="t"))
    if prior is not None:
        for kind, rows in zip("ab", segments.last_aliases(prior), strict=True):
            whole = whole.unionByName(cell(first(rest(rows.join(s.select("league_id").distinct(), "league_id", "left_semi"))), kind, home="s", away="t"))
    cells, far = None, None
    if split:
        of = lambda d: d.join(large, "league_id", "left_semi")
        s, t, sims = cut(segments.with_segments(of(s), size)), cut(of(t)), cut(of(sims))
        near = cut(segments.around(s, t, REACH))
        teams = segments.teams_of(s, segments.PLACE, "s")
        known = teams.join(sims, ["league_id", "s"])
        met = known.join(segments.teams_of(near, segments.PLACE, "t"), [*segments.PLACE, "t"])
        pairs = met.unionByName(known.filter(F.col("sim") >= FAR_NAME).select(met.columns)).distinct()
        cells = cell(s, "s", **event).unionByName(cell(near, "t", **event)).unionByName(cell(pairs, "p", home="s", away="t", sim="sim"))
        if maps is not None:
            mapped = segments.by_team_pair(s, t, of(maps), 1 << 40)
            cells = cells.unionByName(cell(mapped, "t", **event)).unionByName(cell(teams.join(of(maps), ["league_id", "s"]), "m", home="s", away="t"))
        alike = sims.filter(F.col("sim") >= FAR_NAME).select("league_id", "s", "t")

        def far(learned: DataFrame | None) -> DataFrame:
            possible = alike if learned is None else alike.unionByName(learned).distinct()
            return cell(segments.by_team_pair(s, t, possible, L5_GAP), "t", **event)

    return segments.settle(whole, cells, _event_cell, far, None if prior is None or not split else of(prior))


def two_rounds(source: DataFrame, target: DataFrame, vote) -> DataFrame:
    """Match, let ``vote`` derive a team map from the matches, and match again with it."""
    source, target = cut(source), cut(target)
    first = cut(match_events(source, target))
    return cut(match_events(source, target, vote(first)))


def tier_scores(pairs: DataFrame, gap: Column, same_day: Column, name: Column) -> DataFrame:
    """``pairs`` with the first of tiers L1-L3 that they satisfy (``rule``) and its score (E2, E3, stateless)."""
    rule, score = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for label, sigma, most, least_name, w_time, w_name, least, alias in fixed.EVENT_LEVELS:
        if alias:
            continue
        value = F.lit(w_time) * gaussian_time(gap, sigma) + F.lit(w_name) * name
        fits = (same_day if most is None else (gap <= most)) & (name >= least_name) & (value >= least)
        rule, score = rule.when(fits, label), score.when(fits, value)
    return pairs.withColumn("rule", rule).withColumn("score", score)


def best_by_tier(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """The best target of each source row: lowest tier, then score, then target id."""
    w = Window.partitionBy(source).orderBy("rule", F.col("score").desc(), target)
    return pairs.filter("rule is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def tiered_candidates(source: DataFrame, target: DataFrame, keys: list[str], source_time: str, target_time: str, name: Column | None = None) -> DataFrame:
    """Candidates within a day of each other with their tier; join on buckets of time, score after."""
    pairs = time_window_join(source, target, keys, source_time, target_time, DAY)
    gap = F.abs(F.col(source_time) - F.col(target_time))
    day = utc_day(F.col(source_time)) == utc_day(F.col(target_time))
    return tier_scores(pairs.withColumn("time_diff", gap), F.col("time_diff"), day, F.lit(1.0) if name is None else name)


def unique_candidates(pairs: DataFrame, source: str) -> DataFrame:
    """Pairs whose source row has exactly one candidate."""
    return pairs.withColumn("_n", F.count("*").over(Window.partitionBy(source))).filter("_n = 1").drop("_n")


def id_pair_matches(source: DataFrame, target: DataFrame, team_map: DataFrame) -> DataFrame:
    """The best target with exactly the mapped teams, whatever the time."""
    m = lambda side: team_map.select("league_id", F.col("s").alias(f"{side}_id"), F.col("t").alias(f"want_{side}"))
    wanted = source.join(m("home"), ["league_id", "home_id"]).join(m("away"), ["league_id", "away_id"])
    t = target.select("league_id", F.col("event_id").alias("target_id"), F.col("start_unix").alias("target_time"), F.col("home_id").alias("want_home"), F.col("away_id").alias("want_away"))
    pairs = wanted.join(t, ["league_id", "want_home", "want_away"])
    gap = F.abs(F.col("start_unix") - F.col("target_time"))
    scored = pairs.withColumn("time_diff", gap).withColumn("score", 0.75 + 0.10 * gaussian_time(F.col("time_diff"), 3600))
    w = Window.partitionBy("league_id", "event_id").orderBy(F.col("score").desc(), "target_id")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("league_id", "event_id", "target_id", round3(F.col("score")).alias("confidence"), "time_diff")


#: (widest gap in seconds, least name similarity) of the offline matcher's levels; no gap stands for the same UTC day.
OFFLINE_LEVELS = ((300, 0.40), (21600, 0.65), (None, 0.75), (259200, 0.85))


def match_levels(source: pd.DataFrame, target: pd.DataFrame, sims: dict, levels: list[tuple]) -> dict:
    """{place of a source row: (place of its target row, level, similarity)}: all events at one level (number, gap, least), then those left at the next."""
    times, free, done = target["start"].to_numpy(), target["start"].to_numpy() != 0, {}
    teams = list(zip(target["home"], target["away"], strict=True))
    get = lambda a, b: sims.get((a, b), 0.0)
    events = list(zip(source["start"], source["home"], source["away"], strict=True))
    for level, gap, least in levels:
        for i, (start, home, away) in enumerate(events):
            if i in done or not start:
                continue
            low, high = (start - gap, start + gap) if gap is not None else (start // DAY * DAY, start // DAY * DAY + DAY - 1)
            found = np.arange(np.searchsorted(times, low, "left"), np.searchsorted(times, high, "right"))
            best, at = -1.0, -1
            for j in found[free[found]].tolist():
                h, a = teams[j]
                n = max(get(home, h) + get(away, a), get(home, a) + get(away, h)) / 2
                if n >= least and n > best:
                    best, at = n, j
            if at >= 0:
                free[at] = False
                done[i] = (at, level, best)
    return done


def _level_cell(levels: list[tuple]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The offline matcher on one cell of :mod:`.segments`; events without a match come out as such."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = (pdf["league_id"].iloc[0], int(pdf["seg"].iloc[0]))
        source, target, sims = _cell_events(pdf)
        done = match_levels(source, target, sims, levels)
        t = list(zip(target["id"], target["home"], target["away"], target["start"], strict=True))
        out = []
        for n, (e, home, away) in enumerate(zip(source["id"], source["home"], source["away"], strict=True)):
            j, level, score = done.get(n, (-1, 0, 0.0))
            tid, th, ta, start = t[j] if level else ("", "", "", None)
            out.append((*place, "r", n, e, tid, f"EVENT_L{level}" if level else "EVENT_NO_MATCH", round(score, 4), 0, bool(level), home, away, th, ta, start))
        return _out(out)

    return run


def level_major(source: DataFrame, target: DataFrame, levels: tuple = OFFLINE_LEVELS, size: int = segments.SEGMENT) -> DataFrame:
    """The offline matcher (E10): all events at the first level, then those left at the next; sides may be swapped.

    Teams are their names, compared by the offline similarity; an event without a time matches at no level. Leagues of
    more than ``size`` source events go level by level, each settled by segments, with the result of one ordered pass.
    """
    numbered = [(i, *x) for i, x in enumerate(levels, 1)]
    s, t = (segments.event_rows(d, k, team_name("home"), team_name("away")) for d, k in ((source, "s"), (target, "t")))
    t = t.distinct()
    sims = team_pairs(source, target, offline_pair_scores, team_name)
    cell, event = segments.cell, dict(id="id", start="start", home="home", away="away")
    large = cut(segments.large_leagues(s, t, size))
    split = not large.isEmpty()
    rest = (lambda d: d.join(large, "league_id", "left_anti")) if split else (lambda d: d)
    first = lambda d: d.withColumn("seg", F.lit(0))
    whole = cell(first(rest(s)), "s", **event).unionByName(cell(first(rest(t)), "t", **event)).unionByName(cell(first(rest(sims)), "p", home="s", away="t", sim="sim"))
    names = ["league_id", "event_id", "target_id", "rule", "confidence", "matched"]
    found = segments.settle(whole, None, _level_cell(numbered)).select(names)
    if not split:
        return found
    of = lambda d: d.join(large, "league_id", "left_semi")
    s, t, sims = cut(of(s)), cut(of(t)), cut(of(sims))
    for number, gap, least in numbered:
        parts = cut(segments.with_segments(s, size))
        near = cut(segments.around(parts.filter("start != 0"), t.filter("start != 0"), DAY if gap is None else gap))
        pairs = segments.teams_of(parts, segments.PLACE, "s").join(sims, ["league_id", "s"]).join(segments.teams_of(near, segments.PLACE, "t"), [*segments.PLACE, "t"])
        cells = cell(parts, "s", **event).unionByName(cell(near, "t", **event)).unionByName(cell(pairs, "p", home="s", away="t", sim="sim"))
        out = cut(segments.settle(whole.limit(0), cells, _level_cell([(number, gap, least)])))
        found = found.unionByName(out.filter("matched").select(names))
        s = cut(parts.join(out.filter("not matched").select("league_id", "seg", F.col("event_id").alias("id"), F.col("home_id").alias("home"), F.col("away_id").alias("away")).distinct(), ["league_id", "seg", "id", "home", "away"], "left_semi").drop("seg"))  # noqa: E501
        taken = out.filter("matched").select("league_id", F.col("target_id").alias("id"), F.col("target_start").alias("start"), F.col("target_home_id").alias("home"), F.col("target_away_id").alias("away"))
        t = cut(t.join(taken, ["league_id", "id", "start", "home", "away"], "left_anti"))
    return found.unionByName(s.select("league_id", F.col("id").alias("event_id"), F.lit("").alias("target_id"), F.lit("EVENT_NO_MATCH").alias("rule"), F.lit(0.0).alias("confidence"), F.lit(False).alias("matched")))
