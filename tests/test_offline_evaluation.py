"""The offline evaluator's matcher against a plain pass in Python, by segments and whole; the evaluation's table."""

import difflib
import math
import random
import re
from collections import defaultdict

import pandas as pd
import pytest

from linkloom.functions import fixed
from linkloom.operators import offline
from linkloom.plans import evaluation

from .test_segments import EVENT, T0, games

DAY = 86400


def plain(source, target, sims):
    """One league: source and target rows in order, sims by ids."""
    get = lambda a, b: sims.get((a, b), 0.0)
    votes, used, out = defaultdict(dict), set(), {}

    def alias(s):
        return max(votes[s], key=votes[s].get) if votes[s] else None

    def judge(e, t, ids):
        _, _, time, h, hn, a, an = e
        _, _, at, th, _, ta, _ = t
        gap, fwd, rev = abs(time - at), (get(h, th) + get(a, ta)) / 2, (get(h, ta) + get(a, th)) / 2
        if rev > fwd + 0.15:
            return None
        hit = alias(h) == th or alias(a) == ta
        name = max(fwd, 0.92) if hit else fwd
        if ids and ids.get(h) == th and ids.get(a) == ta:
            return "EVENT_L4B", 0.95, name
        if any(re.match(r"(?i)(WQF|Winner R\d+|Winner of|TBD$|TBA$)", n or "") for n in (hn, an)):
            return ("EVENT_L6", 0.70, name) if gap <= 300 else None
        for rule, sigma, most, least_name, wt, wn, least, needs in fixed.TEST_LEVELS:
            if gap <= most and (hit or not needs) and name >= least_name:
                score = wt * math.exp(-(gap**2) / (2 * sigma**2)) + wn * name
                if score >= least:
                    return rule, score, name
        return None

    for e in source:
        best, at = (None, 0.0, 0.0), None
        for t in target:
            if t[1] not in used and abs(e[2] - t[2]) <= 259200 and (got := judge(e, t, {})) and got[1] > best[1]:
                best, at = got, t
        if at:
            used.add(at[1])
            out[e[1]] = (at[1], best[0])
            h, a, th, ta = e[3], e[5], at[3], at[5]
            if best[2] >= 0.5:
                pairs = ((h, th), (a, ta)) if get(h, th) + get(a, ta) >= get(h, ta) + get(a, th) else ((h, ta), (a, th))
                for s, t in pairs:
                    votes[s][t] = votes[s].get(t, 0) + 1
    cast, ids, by = defaultdict(dict), {}, {t[1]: t for t in target}
    for e in source:
        if e[1] in out:
            t = by[out[e[1]][0]]
            for s, x in ((e[3], t[3]), (e[5], t[5])):
                cast[s][x] = cast[s].get(x, 0) + 1
    for s, own in cast.items():
        if own[best := max(own, key=own.get)] >= 2:
            ids[s] = best
    for e in source:
        if e[1] not in out:
            for t in target:
                if t[1] not in used and abs(e[2] - t[2]) <= 259200 and (got := judge(e, t, ids)) and got[0] == "EVENT_L4B":
                    used.add(t[1])
                    out[e[1]] = (t[1], "EVENT_L4B")
                    break
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 2000), (1, 12), (2, 12)])
def test_against_a_plain_pass(spark, seed, size):
    rng = random.Random(seed)
    order = lambda rows: sorted([(*r[:2], r[2] or 0, *r[3:5], r[5] or "x", r[6]) for r in rows], key=lambda r: (r[2], r[1], r[3], r[5]))
    source = order(games(rng, 100, "s", 20, other_names=True))
    source = [(*r[:4], "Winner R1" if i % 25 == 7 else r[4], r[5], r[6]) for i, r in enumerate(source)]
    target = order(games(rng, 100, "t", 20))
    s, t = spark.createDataFrame(source, EVENT), spark.createDataFrame(target, EVENT)
    sims = {(r["s"], r["t"]): r["sim"] for r in offline.team_pairs(s, t, offline.pair_scores).collect()}
    got = {r["event_id"]: (r["target_id"], r["rule"]) for r in offline.match_offline(s, t, size).collect()}
    want = plain(source, target, sims)
    assert {e: x for e, x in got.items() if x[0]} == want
    assert set(got) == {r[1] for r in source} and len({x[1] for x in want.values()}) >= 4


def ordered(rows):
    return sorted([(*r[:2], r[2] or 0, *r[3:5], r[5] or "x", r[6]) for r in rows], key=lambda r: (r[2], r[1], r[3], r[5]))


def test_leagues_go_in_batches(spark, monkeypatch):
    """Small leagues do not cost a call of Python each (F2): one batch, many, and segments give each league's plain pass."""
    rng = random.Random(5)
    leagues = [f"L{i}" for i in range(8)]
    source = [r for x in leagues for r in ordered(games(rng, 25, f"{x}s", 9, x, other_names=True))] + [("no target", "q", T0, "h", "Ajax", "a", "Porto")]
    source = [(*r[:4], "TBD" if i % 25 == 7 else r[4], r[5], r[6]) for i, r in enumerate(source)]
    target = [r for x in leagues for r in ordered(games(rng, 25, f"{x}t", 9, x, other_names=x == "L3"))]
    s, t = spark.createDataFrame(source, EVENT), spark.createDataFrame(target + target[:9], EVENT)
    sims = defaultdict(dict)
    for r in offline.team_pairs(s, t, offline.pair_scores).collect():
        sims[r["league_id"]][r["s"], r["t"]] = r["sim"]
    own = lambda rows, x: [r for r in rows if r[0] == x]
    want = {e: m for x in leagues for e, m in plain(own(source, x), own(target, x), sims[x]).items()}
    found = offline.match_offline(s, t)
    assert "FlatMapGroupsInPandas [batch" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    assert {r[1]: (r[2], r[3]) for r in rows if r[2]} == want and len(rows) == len(source)
    assert len({m[1] for m in want.values()}) >= 5
    monkeypatch.setattr(offline, "ROWS", 200)
    assert sorted(map(tuple, offline.match_offline(s, t).collect())) == rows
    assert sorted(map(tuple, offline.match_offline(s, t, size=12).collect())) == rows


def test_pairs_judged_in_parts(monkeypatch):
    """How many pairs are judged at a time, and whether as an array, changes nothing."""
    rng = random.Random(6)
    row = lambda kind, e: (e[0], kind, e[1], e[2], e[3], e[5], kind == "s" and e[4] == "Ajax", e[4], e[6], None)
    made = [row(k, e) for x in ("L", "M") for k in "st" for e in ordered(games(rng, 60, f"{x}{k}", 12, x, other_names=k == "s"))]
    names = [sorted({n for r in made if r[1] == k for n in r[7:9]}) for k in "st"]
    made += [(None, "p", None, 0, None, None, False, a, b, difflib.SequenceMatcher(None, a, b).ratio()) for a in names[0] for b in names[1]]
    frame = pd.DataFrame(made, columns=["league_id", "kind", "id", "start", "home", "away", "slot", "home_name", "away_name", "sim"])
    want = offline._leagues(frame.copy())
    assert want["rule"].nunique() >= 5
    for pairs, wide in ((1, 48), (100, 0), (1 << 18, 0)):
        monkeypatch.setattr(offline, "PAIRS", pairs)
        monkeypatch.setattr(offline, "WIDE", wide)
        pd.testing.assert_frame_equal(offline._leagues(frame.copy()), want)


@pytest.mark.parametrize("size", [2000, 1])
def test_an_id_at_two_times_comes_out_twice(spark, size):
    """A source event that stands at two times, of which one finds no target, is not matched again at the other."""
    at = lambda p, *days: [("L", f"{p}{i}", T0 + d * DAY, f"{p}h", "Arsenal", f"{p}a", "Chelsea") for i, d in days]
    s, t = spark.createDataFrame(at("s", (0, 0), (1, 8), (1, 30)), EVENT), spark.createDataFrame(at("t", (0, 0), (1, 8), (2, 9)), EVENT)
    got = sorted((r["event_id"], r["target_id"], r["rule"]) for r in offline.match_offline(s, t, size).collect())
    assert got == [("s0", "t0", "EVENT_L1"), ("s1", "", "EVENT_NO_MATCH"), ("s1", "t1", "EVENT_L1")]


def test_evaluation(spark):
    games_of = lambda league, p: [(league, f"{league}{p}{i}", T0 + i * DAY, f"{p}h", "Arsenal", f"{p}a", "Chelsea") for i in range(3)]
    events = spark.createDataFrame(games_of("L", "s") + games_of("R", "s") + games_of("N", "s"), EVENT)
    kind = EVENT.replace("league_id", "competition_id")
    targets = spark.createDataFrame([("cL", *r[1:]) for r in games_of("L", "t")], kind)
    leagues = spark.createDataFrame([("L", "cL"), ("R", "cR"), ("N", ""), ("E", "cE")], "league_id string, competition_id string")
    known = [("L", f"Ls{i}", f"Lt{i}", T0 + i * DAY, "th", "Arsenal", "ta", "Chelsea") for i in range(2)] + [("L", "Ls2", "elsewhere", T0, "th", "A", "ta", "B")]
    known += [("R", f"Rs{i}", f"Rt{i}", T0 + i * DAY, "th", "Arsenal", "ta", "Chelsea") for i in range(2)]
    matches, stats = evaluation.evaluate(leagues, events, targets, spark.createDataFrame(known, evaluation.TRUTH))
    got = {r["league_id"]: r for r in stats.collect()}
    assert {k: r["note"] for k, r in got.items()} == {"L": "file", "R": "truth", "N": "no target events", "E": "no source events"}
    assert (got["L"]["n_matched"], got["L"]["tp"], round(got["L"]["precision"], 3), round(got["L"]["recall"], 3)) == (3, 2, 0.667, 0.667)
    assert (got["R"]["n_source"], got["R"]["n_target"], got["R"]["n_matched"], got["R"]["precision"]) == (3, 2, 2, 1.0)
    assert got["N"]["n_matched"] == 0 and matches.filter("league_id = 'N'").count() == 0
