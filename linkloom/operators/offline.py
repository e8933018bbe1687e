"""The offline evaluator's event matcher (E11): one greedy pass that learns aliases by votes, then a pass by team ids.

A source event takes, of the free targets within three days, the one with the highest score; a pair's score is that of
the first level it satisfies. Team ids that at least two matches agree on then match events that are left. Leagues that
are small go through both passes in one call, many leagues at a time; large leagues go by segments (:mod:`.segments`), with
the result of one ordered pass.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import offline_similarity
from . import segments
from .events import ALIAS_LEARN, ALIAS_SCORE, NAMED, REACH, RESULT, _cell_events, _columns, _out, matches_of, team_key, team_name, team_pairs
from .lineage import cut

REVERSED = 0.15
BY_ID, SLOT, SLOT_GAP = 0.95, 0.70, 300
#: The rules of the first pass, by number.
RULES = [*[level[0] for level in fixed.TEST_LEVELS], "EVENT_L6"]
#: Events and pairs of names in a batch of leagues, about; pairs of events that are judged at a time; candidates of an event
#: from which on they are compared as an array.
ROWS, PAIRS, WIDE = 30_000, 1 << 18, 48


class Votes:
    """Votes for which target team a source team is; of equal votes the first stands. Teams are numbers."""

    def __init__(self):
        self.cast: dict[int, dict[int, int]] = {}
        self.log: list[tuple[int, int]] = []

    def add(self, s: int, t: int, n: int = 1) -> None:
        own = self.cast.setdefault(s, {})
        own[t] = own.get(t, 0) + n

    def learn(self, s: int, t: int, real: list[bool]) -> None:
        if real[s] and real[t]:
            self.add(s, t)
            self.log.append((s, t))

    def of(self, s: int) -> int:
        own = self.cast.get(s)
        return max(own, key=own.get) if own else -1


class Similarities:
    """Similarities of pairs of numbers below ``width``; 0 for a pair that is not given and for numbers below 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sim: np.ndarray, width: int):
        key = x * width + y
        order = np.argsort(key)
        self.key, self.sim, self.width = np.append(key[order], np.iinfo(np.int64).max), np.append(sim[order], 0.0), width

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * self.width + b
        at = np.searchsorted(self.key, want)
        return np.where((self.key[at] == want) & (b >= 0), self.sim[at], 0.0)


@dataclass
class Games:
    """Events of one side as columns, league by league (numbers in ascending order) and there in order; teams and names are numbers."""

    league: np.ndarray
    start: np.ndarray
    home: np.ndarray
    away: np.ndarray
    home_name: np.ndarray
    away_name: np.ndarray
    slot: np.ndarray | None = None


def _reach(s: Games, t: Games) -> tuple[np.ndarray, np.ndarray]:
    """Where the targets within REACH of each source event begin and end."""
    low, high = np.zeros(len(s.start), dtype=np.int64), np.zeros(len(s.start), dtype=np.int64)
    numbers, first = np.unique(s.league, return_index=True)
    begins, ends = np.searchsorted(t.league, numbers, "left").tolist(), np.searchsorted(t.league, numbers, "right").tolist()
    for a, b, c, d in zip(first.tolist(), [*first.tolist()[1:], len(s.league)], begins, ends, strict=True):
        low[a:b] = c + np.searchsorted(t.start[c:d], s.start[a:b] - REACH, "left")
        high[a:b] = c + np.searchsorted(t.start[c:d], s.start[a:b] + REACH, "right")
    return low, high


def _direction(s: Games, t: Games, i: np.ndarray, j: np.ndarray, sim: Similarities) -> tuple[np.ndarray, np.ndarray]:
    straight = (sim(s.home_name[i], t.home_name[j]) + sim(s.away_name[i], t.away_name[j])) / 2
    return straight, (sim(s.home_name[i], t.away_name[j]) + sim(s.away_name[i], t.home_name[j])) / 2


def _levels(name: np.ndarray, gap: np.ndarray, alias: bool) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of the first level that each pair satisfies; 0 and -1 where there is none."""
    score, rule = np.zeros(len(name)), np.full(len(name), -1)
    for number, (_, sigma, most, least_name, w_time, w_name, least, needs) in enumerate(fixed.TEST_LEVELS):
        if needs and not alias:
            continue
        at = np.flatnonzero((rule < 0) & (gap <= most) & (name >= least_name))
        value = w_name * name[at]
        if w_time:
            value = w_time * np.array([math.exp(-(g**2) / (2 * sigma**2)) for g in gap[at].tolist()]) + value
        good = value >= least
        score[at[good]], rule[at[good]] = value[good], number
    return score, rule


def _judged(s: Games, t: Games, i: np.ndarray, j: np.ndarray, sim: Similarities) -> tuple[np.ndarray, ...]:
    """The pairs (i, j) that can match: i, j, both directions, then score and level without and with an alias."""
    straight, crossed = _direction(s, t, i, j, sim)
    on = ~(crossed > straight + REVERSED)
    i, j, straight, crossed = i[on], j[on], straight[on], crossed[on]
    gap, slot = np.abs(s.start[i] - t.start[j]), s.slot[i]
    judged = []
    for alias in (False, True):
        score, rule = _levels(np.maximum(straight, ALIAS_SCORE) if alias else straight, gap, alias)
        judged += [np.where(slot, np.where(gap <= SLOT_GAP, SLOT, 0.0), score), np.where(slot, len(fixed.TEST_LEVELS), rule)]
    on = (judged[0] > 0) | (judged[2] > 0)
    return tuple(x[on] for x in (i, j, straight, crossed, *judged))


def match_by_names(s: Games, t: Games, sim: Similarities, real: list[bool], free: bytearray, votes: Votes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Target (-1: none), rule and score of each source event in the first pass; what it takes is no longer ``free``.

    What a pair scores with and without an alias does not depend on the order, so it is found for PAIRS pairs at a time. ``real``
    tells teams with an id. ``votes`` are those that a single league begins with.
    """
    low, high = _reach(s, t)
    ends = np.cumsum(high - low)
    target, rules, scores = np.full(len(s.start), -1), np.full(len(s.start), -1), np.zeros(len(s.start))
    is_free, t_home, t_away = np.frombuffer(free, dtype=np.uint8) if free else np.zeros(0, dtype=np.uint8), t.home.tolist(), t.away.tolist()
    begin, league = 0, None
    while begin < len(s.start):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        count = (high - low)[begin:end]
        i = np.repeat(np.arange(begin, end), count)
        j = np.arange(len(i)) + np.repeat(low[begin:end] - np.cumsum(count) + count, count)
        i, j, straight, crossed, plain, plain_rule, aliased, alias_rule = _judged(s, t, i, j, sim)
        at = np.searchsorted(i, np.arange(begin, end + 1)).tolist()
        js, plains, aliases = j.tolist(), plain.tolist(), aliased.tolist()
        for n, (number, home, away) in enumerate(zip(s.league[begin:end].tolist(), s.home[begin:end].tolist(), s.away[begin:end].tolist(), strict=True)):
            if number != league:
                votes, league = votes if league is None and votes else Votes(), number
            a, b, best, found = at[n], at[n + 1], 0.0, -1
            if a == b:
                continue
            to_home, to_away = votes.of(home), votes.of(away)
            if b - a > WIDE:
                near = j[a:b]
                score = np.where((t.home[near] == to_home) | (t.away[near] == to_away), aliased[a:b], plain[a:b]) * is_free[near]
                found = a + int(score.argmax()) if score.max() > 0 else -1
            else:
                for p in range(a, b):
                    k = js[p]
                    if free[k]:
                        score = aliases[p] if t_home[k] == to_home or t_away[k] == to_away else plains[p]
                        if score > best:
                            best, found = score, p
            if found < 0:
                continue
            k = js[found]
            alias = t_home[k] == to_home or t_away[k] == to_away
            free[k] = 0
            target[begin + n] = k
            rules[begin + n], scores[begin + n] = (alias_rule if alias else plain_rule)[found], (aliased if alias else plain)[found]
            if alias or straight[found] >= ALIAS_LEARN:
                h, w = (t_home[k], t_away[k]) if straight[found] >= crossed[found] else (t_away[k], t_home[k])
                votes.learn(home, h, real)
                votes.learn(away, w, real)
        begin = end
    return target, rules, scores


def match_by_ids(s: Games, t: Games, sim: Similarities, free: bytearray, wanted: dict[int, tuple[int, int]]) -> dict[int, int]:
    """{source event: target} of the events in ``wanted``, in order: the first free target, in order of time, with the mapped teams."""
    low, high = _reach(s, t)
    targets: dict[tuple, list[int]] = {(int(s.league[i]), *teams): [] for i, teams in wanted.items()}
    for k, place in enumerate(zip(t.league.tolist(), t.home.tolist(), t.away.tolist(), strict=True)):
        if place in targets:
            targets[place].append(k)
    done: dict[int, int] = {}
    for i, teams in sorted(wanted.items()):
        alike = targets[int(s.league[i]), *teams]
        for k in alike[bisect_left(alike, low[i]) : bisect_left(alike, high[i])]:
            if free[k]:
                straight, crossed = _direction(s, t, np.array([i]), np.array([k]), sim)
                if crossed[0] <= straight[0] + REVERSED:
                    free[k] = 0
                    done[i] = k
                break
    return done


def _numbered(*columns: pd.Series | np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The values of the columns as numbers (-1: null), the same in all of them, and the values."""
    every, values = pd.factorize(np.concatenate([np.asarray(c, dtype=object) for c in columns]))
    return np.split(every.astype(np.int64), np.cumsum([len(c) for c in columns])[:-1]), values


def _real(teams: np.ndarray) -> list[bool]:
    return [bool(x) and not x.startswith(NAMED) for x in teams]


def _cell(by_ids: bool):
    """One segment of a large league; where a pass by names finds no target, ``target_start`` is the event's own time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = (pdf["league_id"].iloc[0], int(pdf["seg"].iloc[0]))
        source, target, sims = _cell_events(pdf)
        cast = sorted(_columns(pdf, "v", "home", "away", "start", "sim"), key=lambda v: (v[0], v[3]))
        mapped, pairs = dict(_columns(pdf, "m", "home", "away")), list(sims)
        sides = [source["home"], source["away"], target["home"], target["away"]]
        (home, away, t_home, t_away, x, y, vs, vt, ms, mt), teams = _numbered(*sides, *[[v[k] for v in rows] for rows in (pairs, cast, list(mapped.items())) for k in (0, 1)])
        league = lambda d: np.zeros(len(d), dtype=np.int64)
        s = Games(league(source), source["start"].to_numpy(), home, away, home, away, source["slot"].to_numpy(dtype=bool))
        t = Games(league(target), target["start"].to_numpy(), t_home, t_away, t_home, t_away)
        sim, free, votes = Similarities(x, y, np.array(list(sims.values()), dtype=float), len(teams)), bytearray(b"\1" * len(target)), Votes()
        for a, b, v in zip(vs.tolist(), vt.tolist(), cast, strict=True):
            votes.add(a, b, int(v[2]))
        if by_ids:
            ids = dict(zip(ms.tolist(), mt.tolist(), strict=True))
            wanted = {i: (ids[h], ids[a]) for i, (h, a) in enumerate(zip(home.tolist(), away.tolist(), strict=True)) if h in ids and a in ids}
            done = {i: (k, "EVENT_L4B", BY_ID) for i, k in match_by_ids(s, t, sim, free, wanted).items()}
        else:
            found = zip(*[x.tolist() for x in match_by_names(s, t, sim, _real(teams), free, votes)], strict=True)
            done = {i: (k, RULES[rule], score) for i, (k, rule, score) in enumerate(found) if k >= 0}
        rows = list(zip(target["id"], target["home"], target["away"], target["start"], strict=True))
        out = []
        for n, (e, start, home_, away_) in enumerate(zip(source["id"], source["start"], source["home"], source["away"], strict=True)):
            k, rule, score = done.get(n, (-1, "EVENT_NO_MATCH", 0.0))
            tid, th, ta, at = rows[k] if k >= 0 else ("", "", "", start)
            out.append((*place, "r", n, e, tid, rule, score, abs(int(start) - int(at)), k >= 0, home_, away_, th, ta, at))
        return _out(out + [(*place, "l", n, "", "", "", 0.0, 0, False, teams[a], "", teams[b], "", None) for n, (a, b) in enumerate(votes.log)])

    return run


def _name_sets(leagues: np.ndarray, teams: np.ndarray, names: np.ndarray, known: dict[tuple, int]) -> np.ndarray:
    """For each row the number of the set of names that its team has in its league; ``known`` has the sets of several names."""
    rows = pd.DataFrame({"l": leagues, "t": teams, "n": names})
    once = rows.drop_duplicates()
    several = once[once.duplicated(["l", "t"], keep=False)]
    if several.empty:
        return names
    sets = {place: known.setdefault(tuple(sorted(of)), -2 - len(known)) for place, of in several.groupby(["l", "t"])["n"]}
    return np.array([sets.get((league, team), n) for league, team, n in rows.itertuples(index=False)], dtype=np.int64)


def _leagues(pdf: pd.DataFrame) -> pd.DataFrame:
    """Both passes over a batch of whole leagues: rows of kinds s and t are events, of kind p pairs of names."""
    order = ["_l", "start", "id", "home", "away"]
    pdf["_l"] = pd.factorize(pdf["league_id"], use_na_sentinel=False)[0]
    source = pdf[pdf["kind"] == "s"].astype({"start": "int64", "slot": "bool"}).sort_values(order, kind="stable")
    every = pdf[pdf["kind"] == "t"].astype({"start": "int64"}).sort_values(order, kind="stable")
    pairs, once = pdf[pdf["kind"] == "p"], ~every.duplicated(order).to_numpy()
    (home, away, t_home, t_away), teams = _numbered(source["home"], source["away"], every["home"], every["away"])
    (*names, x, y), words = _numbered(source["home_name"], source["away_name"], every["home_name"], every["away_name"], pairs["home_name"], pairs["away_name"])
    # a team that goes by several names in a league is as alike as the likest of them
    s_league, t_league = source["_l"].to_numpy(), every["_l"].to_numpy()
    twice, s_sets, t_sets = (lambda v: np.concatenate([v, v])), {}, {}
    s_name = _name_sets(twice(s_league), np.concatenate([home, away]), np.concatenate(names[:2]), s_sets)
    t_name = _name_sets(twice(t_league), np.concatenate([t_home, t_away]), np.concatenate(names[2:4]), t_sets)
    likes = pd.DataFrame({"x": x, "y": y, "sim": pairs["sim"].to_numpy(dtype=float)})
    for column, sets in (("x", s_sets), ("y", t_sets)):
        if sets:
            of = pd.DataFrame([(n, len(words) - 2 - number) for members, number in sets.items() for n in members], columns=[column, "set"])
            more = likes.merge(of, on=column).drop(columns=column).rename(columns={"set": column})
            likes = pd.concat([likes, more.groupby(["x", "y"], as_index=False)["sim"].max()])
    number = lambda v: np.where(v < -1, len(words) - 2 - v, v)
    (s_home_name, s_away_name), (t_home_name, t_away_name) = np.split(number(s_name), 2), np.split(number(t_name), 2)
    sim = Similarities(likes["x"].to_numpy(dtype=np.int64), likes["y"].to_numpy(dtype=np.int64), likes["sim"].to_numpy(), len(words) + max(len(s_sets), len(t_sets)))
    target = every[once]
    s = Games(s_league, source["start"].to_numpy(), home, away, s_home_name, s_away_name, source["slot"].to_numpy())
    t = Games(t_league[once], target["start"].to_numpy(), t_home[once], t_away[once], t_home_name[once], t_away_name[once])
    free = bytearray(b"\1" * len(target))
    at, rules, scores = match_by_names(s, t, sim, _real(teams), free)
    rules = np.array([*RULES, "EVENT_L4B", "EVENT_NO_MATCH"], dtype=object)[rules]
    again = match_by_ids(s, t, sim, free, _mapped(s, t, at))
    for i, k in again.items():
        at[i], rules[i], scores[i] = k, "EVENT_L4B", BY_ID
    taken = lambda c, none: np.append(target[c].to_numpy(), [none])[at]
    return pd.DataFrame({
        "league_id": source["league_id"].to_numpy(), "event_id": source["id"].to_numpy(), "target_id": taken("id", ""), "rule": rules, "confidence": scores,
        "time_diff": np.where(at >= 0, np.abs(s.start - taken("start", 0)), 0), "matched": at >= 0, "home_id": source["home"].to_numpy(), "away_id": source["away"].to_numpy(),
        "target_home_id": taken("home", ""), "target_away_id": taken("away", ""),
    })


def _mapped(s: Games, t: Games, at: np.ndarray) -> dict[int, tuple[int, int]]:
    """{source event without a target: target teams of its teams}, as :func:`team_ids` maps them."""
    cast: dict[tuple[int, int], dict[int, int]] = {}
    events = list(zip(s.league.tolist(), s.home.tolist(), s.away.tolist(), at.tolist(), strict=True))
    t_home, t_away = t.home.tolist(), t.away.tolist()
    for league, home, away, k in events:
        if k >= 0:
            for a, b in ((home, t_home[k]), (away, t_away[k])):
                own = cast.setdefault((league, a), {})
                own[b] = own.get(b, 0) + 1
    ids = {team: b for team, own in cast.items() if own[b := max(own, key=own.get)] >= 2}
    return {i: (ids[league, home], ids[league, away]) for i, (league, home, away, k) in enumerate(events) if k < 0 and (league, home) in ids and (league, away) in ids}


def team_ids(matches: DataFrame) -> DataFrame:
    """(league_id, s, t): the target team that most matches of a source team have, two at least; of equal votes the first."""
    side = lambda k, x: F.struct(F.lit(k).alias("k"), F.col(f"{x}_id").alias("s"), F.col(f"target_{x}_id").alias("t"))
    numbered = matches.filter("kind = 'r' and matched").select("league_id", "seg", "n", F.explode(F.array(side(0, "home"), side(1, "away"))).alias("x"))
    cast = numbered.groupBy("league_id", "x.s", "x.t").agg(F.count("*").alias("votes"), F.min(F.struct("seg", "n", "x.k")).alias("first"))
    w = Window.partitionBy("league_id", "s").orderBy(F.col("votes").desc(), "first")
    return cast.withColumn("_n", F.row_number().over(w)).filter("_n = 1 and votes >= 2").select("league_id", "s", "t")


def pair_scores(pairs: DataFrame) -> DataFrame:
    pairs = pairs.distinct()
    return pairs.select("x", "y", offline_similarity(F.col("x"), F.col("y"), strip_clubs=True).alias("sim"))


def _whole_leagues(source: DataFrame, target: DataFrame, slot: Column) -> DataFrame:
    """Leagues that go through the kernel whole, many at a time: a batch has about ROWS events and pairs of names.

    Names are compared once per distinct pair, and each pair goes to a batch once, however many of its leagues have it.
    """
    named = lambda d, c: d.select("league_id", F.explode(F.array(team_name("home"), team_name("away"))).alias(c)).distinct()
    a, b = cut(named(source, "x")), cut(named(target, "y"))
    size = lambda d, n: d.groupBy("league_id").agg(F.count("*").alias(n))
    met = size(a, "n").join(size(b, "m"), "league_id").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    batches = 1 + (source.count() + target.count() + met) // ROWS
    batch = F.pmod(F.xxhash64("league_id"), F.lit(batches)).alias("batch")
    pairs = cut(a.join(b, "league_id").select(batch, "x", "y").distinct())
    scored = pairs.join(pair_scores(pairs.select("x", "y")), ["x", "y"])

    def rows(d: DataFrame, kind: str, slot: Column) -> DataFrame:
        # events without a league have no names: they match by slots alone
        name = lambda side: F.when(F.col("league_id").isNotNull(), team_name(side)).alias(f"{side}_name")
        start = F.coalesce("start_unix", F.lit(0)).cast("long").alias("start")
        event = [F.col("event_id").alias("id"), start, team_key("home").alias("home"), team_key("away").alias("away"), slot.alias("slot")]
        return d.select(batch, "league_id", F.lit(kind).alias("kind"), *event, name("home"), name("away"))

    compared = scored.select("batch", F.lit("p").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(False).alias("slot"), F.col("x").alias("home_name"), F.col("y").alias("away_name"), "sim")
    every = rows(source, "s", slot).unionByName(rows(target, "t", F.lit(False))).unionByName(compared, allowMissingColumns=True)
    return every.groupBy("batch").applyInPandas(_leagues, RESULT)


def match_offline(source: DataFrame, target: DataFrame, size: int = segments.SEGMENT) -> DataFrame:
    """All leagues at once (E11): canonical events with ``league_id``; the columns of :func:`.events.match_events`."""
    slot = team_name("home").rlike(fixed.TEST_PLACEHOLDER) | team_name("away").rlike(fixed.TEST_PLACEHOLDER)
    large = cut(segments.large_leagues(source, target, size))
    split = not large.isEmpty()
    rest = (lambda d: d.join(large, "league_id", "left_anti")) if split else (lambda d: d)
    found = matches_of(_whole_leagues(rest(source), rest(target), slot).withColumn("kind", F.lit("r")))
    if not split:
        return found
    of = lambda d: d.join(large, "league_id", "left_semi")
    return found.unionByName(_large_leagues(of(source), of(target), slot, size))


def _large_leagues(source: DataFrame, target: DataFrame, slot: Column, size: int) -> DataFrame:
    """Leagues that are settled by segments."""
    s = cut(segments.event_rows(source, "s", team_key("home"), team_key("away"), slot))
    t = cut(segments.event_rows(target, "t", team_key("home"), team_key("away")).distinct())
    sims = cut(team_pairs(source, target, pair_scores))
    cell, event = segments.cell, dict(id="id", start="start", home="home", away="away", slot="slot")

    def settled(s: DataFrame, t: DataFrame, maps: DataFrame | None) -> DataFrame:
        parts = cut(segments.with_segments(s, size))
        near = cut(segments.around(parts, t, REACH))
        teams = segments.teams_of(parts, segments.PLACE, "s")
        pairs = teams.join(sims, ["league_id", "s"]).join(segments.teams_of(near, segments.PLACE, "t"), [*segments.PLACE, "t"])
        cells = cell(parts, "s", **event).unionByName(cell(near, "t", **event)).unionByName(cell(pairs, "p", home="s", away="t", sim="sim"))
        if maps is not None:
            cells = cells.unionByName(cell(teams.join(maps, ["league_id", "s"]), "m", home="s", away="t"))
        none = s.sparkSession.createDataFrame([], segments.OUT)
        return cut(segments.settle(none, cells, _cell(maps is not None), hand_on=segments.votes_handed_on))

    first = settled(s, t, None)
    maps = cut(team_ids(first))
    won = first.filter("kind = 'r' and matched")
    left = first.filter("kind = 'r' and not matched").select("league_id", F.lit("s").alias("kind"), F.col("event_id").alias("id"), F.col("target_start").alias("start"), F.col("home_id").alias("home"), F.col("away_id").alias("away"), F.lit(False).alias("slot"))  # noqa: E501
    taken = won.select("league_id", F.col("target_id").alias("id"), F.col("target_start").alias("start"), F.col("target_home_id").alias("home"), F.col("target_away_id").alias("away"))
    again = settled(cut(left), cut(t.join(taken, ["league_id", "id", "start", "home", "away"], "left_anti")), maps)
    return matches_of(won.unionByName(again.filter("kind = 'r'")))
