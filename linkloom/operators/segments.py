"""Order-dependent matching of leagues of any size, by segments that are settled to a fixpoint.

The matcher takes source events in order; each depends on the targets that earlier ones took and on the aliases that they
taught. A league that fits goes through its kernel whole. The events of a larger one are cut in order into segments of
about ``SEGMENT`` events, each with the targets that it can reach, and all segments run at once. What segments took and
learned is then handed to later segments, and those whose share of it has changed run again, until none has. Then every
segment has run on exactly what the segments before it leave, so the result is that of one ordered pass: the first
segment is right after the first run, and each further segment is right at the latest one round after those before it.

A segment reaches the targets around its time. Targets further off count only if both their teams are alike to, or
aliases of, teams of the segment; such pairs of teams, which grow with what is learned and never shrink, are joined to
the targets by both teams. Nothing of a large league comes together in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Source events of a segment, about; the events of one hour stay together.
SEGMENT = 2000
#: A league with so many times more targets than events fit into a segment is large, too.
TARGETS = 8
HOUR, WEEK = 3600, 7 * 86400
#: A row of a cell; kinds: s source event, t target, p pair of teams and its similarity, m mapped pair of teams,
#: x target that is gone, a and b last target of a source team and last source of a target team.
CELL = ["league_id", "seg", "kind", "id", "start", "home", "away", "slot", "sim"]
KINDS = {"league_id": "string", "seg": "bigint", "kind": "string", "id": "string", "start": "bigint", "home": "string", "away": "string", "slot": "boolean", "sim": "double"}
#: What a kernel returns: matches (kind r) and learned aliases (kind l: home_id means target_home_id), n in order.
OUT = (
    "league_id string, seg bigint, kind string, n bigint, event_id string, target_id string, rule string, confidence double, time_diff bigint, "
    "matched boolean, home_id string, away_id string, target_home_id string, target_away_id string, target_start bigint"
)
PLACE = ["league_id", "seg"]


def cell(df: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
    """Rows of a cell; columns that are not given are null."""
    made = {"league_id": "league_id", "seg": "seg", "kind": F.lit(kind)} | columns
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(*[(as_column(made[c]) if c in made else F.lit(None)).cast(KINDS[c]).alias(c) for c in CELL])


def event_rows(events: DataFrame, kind: str, home: Column, away: Column, slot: Column | None = None) -> DataFrame:
    """(league_id, kind, id, start, home, away, slot) of canonical events; one without a time starts at 0."""
    slot = F.lit(False) if slot is None else slot
    return events.select("league_id", F.lit(kind).alias("kind"), F.col("event_id").alias("id"), F.coalesce("start_unix", F.lit(0)).cast("long").alias("start"), home.alias("home"), away.alias("away"), slot.alias("slot"))


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("league_id").agg(F.count("*").alias(name))


def large_leagues(s: DataFrame, t: DataFrame, size: int) -> DataFrame:
    """(league_id) of the leagues that do not go through a kernel whole."""
    both = _counts(s, "n").join(_counts(t, "m"), "league_id", "left")
    return both.filter((F.col("n") > size) | (F.col("m") > TARGETS * size)).select("league_id")


def with_segments(s: DataFrame, size: int) -> DataFrame:
    """Events with ``seg``, in the order of their times: about ``size`` events in one, events without a time apart."""
    hour = F.floor(F.col("start") / HOUR)
    hours = s.groupBy("league_id", hour.alias("_hour")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("league_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    timed = F.when(F.col("_hour") > 0, F.lit(1 << 40)).otherwise(0)
    hours = hours.select(F.col("league_id").alias("_l"), "_hour", (F.floor(before / size) + timed).cast("long").alias("seg"))
    return s.join(hours, (F.col("league_id") == F.col("_l")) & (hour == F.col("_hour"))).drop("_l", "_hour")


def around(s: DataFrame, t: DataFrame, reach: int) -> DataFrame:
    """Target rows of each segment, those within ``reach`` seconds of its events."""
    spans = s.groupBy(*PLACE).agg((F.min("start") - reach).alias("_low"), (F.max("start") + reach).alias("_high"))
    weeks = F.sequence(F.floor(F.col("_low") / WEEK), F.floor(F.col("_high") / WEEK))
    spans = spans.withColumn("_week", F.explode(weeks))
    met = t.withColumn("_week", F.floor(F.col("start") / WEEK)).join(spans, ["league_id", "_week"])
    return met.filter(F.col("start").between(F.col("_low"), F.col("_high"))).drop("_week", "_low", "_high")


def teams_of(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.select(*keys, F.explode(F.array("home", "away")).alias(name)).distinct()


def by_team_pair(s: DataFrame, t: DataFrame, possible: DataFrame, reach: int) -> DataFrame:
    """Targets of each segment whose teams are possible for the teams of an event, within ``reach`` seconds of it or without a time."""
    pairs = s.groupBy(*PLACE, "home", "away").agg(F.min("start").alias("_low"), F.max("start").alias("_high"))
    side = lambda x: possible.select("league_id", F.col("s").alias(x), F.col("t").alias(f"_{x}"))
    wanted = pairs.join(side("home"), ["league_id", "home"]).join(side("away"), ["league_id", "away"])
    wanted = wanted.select(*PLACE, "_low", "_high", F.col("_home").alias("home"), F.col("_away").alias("away"))
    near = F.col("start").between(F.col("_low") - reach, F.col("_high") + reach) | (F.col("start") == 0)
    return t.join(wanted, ["league_id", "home", "away"]).filter(near).drop("_low", "_high").distinct()


def _last_until(learned: DataFrame, key: str) -> DataFrame:
    """Learned aliases that are the last of their segment for ``key``, with the segment that has the next (null: none)."""
    w = Window.partitionBy("league_id", key).orderBy("seg", "n")
    after = learned.withColumn("_next", F.lead("seg").over(w))
    return after.filter(F.col("_next").isNull() | (F.col("_next") > F.col("seg")))


def aliases_of(out: DataFrame) -> DataFrame:
    """(league_id, seg, n, s, t): the aliases that rows of ``out`` taught, in order."""
    return out.filter("kind = 'l'").select("league_id", "seg", "n", F.col("home_id").alias("s"), F.col("target_home_id").alias("t"))


def last_aliases(learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(league_id, s, t) of the last target of each source team, and of the last source of each target team."""
    last = lambda key: learned.groupBy("league_id", key).agg(F.max_by(F.struct("s", "t"), F.struct("seg", "n")).alias("x")).select("league_id", "x.s", "x.t")
    return last("s"), last("t")


def _handed_on(out: DataFrame, places: DataFrame, s_teams: DataFrame, prior: DataFrame | None) -> DataFrame:
    """What each segment gets from those before it: targets that are gone and the last aliases of its teams.

    ``prior`` are aliases (as :func:`aliases_of` gives them) from before the first segment.
    """
    parts = [_gone(out, places)]
    learned = aliases_of(out)
    if prior is not None:
        learned = learned.unionByName(prior.withColumn("seg", F.lit(-1).cast("long")))
    for kind, key in (("a", "s"), ("b", "t")):
        last = _last_until(learned, key).select("league_id", F.col("seg").alias("_from"), "_next", "s", "t")
        met = s_teams.join(last, ["league_id", "s"]).filter((F.col("seg") > F.col("_from")) & (F.col("_next").isNull() | (F.col("seg") <= F.col("_next"))))
        parts.append(cell(met, kind, home="s", away="t"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def votes_handed_on(out: DataFrame, places: DataFrame, s_teams: DataFrame, prior: DataFrame | None) -> DataFrame:
    """As :func:`_handed_on`, with all votes for aliases (kind v: home voted for away, start times, sim in order) in place of the last ones."""
    cast = aliases_of(out).groupBy("league_id", F.col("seg").alias("_from"), "s", "t").agg(F.count("*").alias("_votes"), F.min("n").alias("_n"))
    met = s_teams.join(cast, ["league_id", "s"]).filter(F.col("seg") > F.col("_from"))
    votes = met.groupBy(*PLACE, "s", "t").agg(F.sum("_votes").alias("votes"), F.min(F.struct("_from", "_n")).alias("_first"))
    votes = votes.withColumn("place", F.row_number().over(Window.partitionBy(*PLACE, "s").orderBy("_first")))
    return _gone(out, places).unionByName(cell(votes, "v", home="s", away="t", start="votes", sim="place"))


def _gone(out: DataFrame, places: DataFrame) -> DataFrame:
    """Targets of each segment that segments before it have taken."""
    target = ["league_id", "id", "start", "home", "away"]
    taken = out.filter("kind = 'r' and matched").groupBy("league_id", F.col("target_id").alias("id"), F.col("target_start").alias("start"), F.col("target_home_id").alias("home"), F.col("target_away_id").alias("away")).agg(F.min("seg").alias("_by"))  # noqa: E501
    return cell(places.join(taken, target).filter(F.col("seg") > F.col("_by")), "x", id="id", start="start", home="home", away="away")


def settle(whole: DataFrame, cells: DataFrame | None, kernel: Callable[[pd.DataFrame], pd.DataFrame], far: Callable[[DataFrame | None], DataFrame] | None = None, prior: DataFrame | None = None, hand_on: Callable | None = None) -> DataFrame:
    """The rows (OUT) of every league: ``whole`` holds cells that are leagues, ``cells`` the segments of large leagues.

    ``kernel`` runs one cell. ``far`` gives the far targets of the segments from all aliases learned so far. ``prior`` are
    aliases from before the first segment, in order of n. ``hand_on`` replaces :func:`_handed_on`.
    """
    run = lambda rows: rows.groupBy(*PLACE).applyInPandas(kernel, OUT)
    if cells is None:
        return run(whole)
    cells = cut(cells)
    s_teams = cut(teams_of(cells.filter("kind = 's'"), PLACE, "s"))
    near = cells.filter("kind = 't'").select(*CELL)
    out = before = None
    learned = None if prior is None else cut(prior.select("league_id", "s", "t").distinct())
    while True:
        added = far(learned) if far else None
        places = near if added is None else near.unionByName(added).distinct()
        now = added
        if out is not None or prior is not None:
            made = out if out is not None else cells.sparkSession.createDataFrame([], OUT)
            handed = (hand_on or _handed_on)(made, places, s_teams, prior)
            now = handed if now is None else now.unionByName(handed)
        now = cut(now if now is not None else cells.limit(0))
        if out is None:
            out = cut(run(cells.unionByName(now)))
        else:
            changed = cut(now.exceptAll(before).unionByName(before.exceptAll(now)).select(*PLACE).distinct())
            if changed.isEmpty():
                break
            again = run(cells.unionByName(now).join(changed, PLACE, "left_semi"))
            out = cut(out.join(changed, PLACE, "left_anti").unionByName(again))
        new = out.filter("kind = 'l'").select("league_id", F.col("home_id").alias("s"), F.col("target_home_id").alias("t"))
        learned = cut((new if learned is None else learned.unionByName(new)).distinct())
        before = now
    return run(whole).unionByName(out)
