"""Evidence-first matching: scored edges with reasons, and one-to-one resolution over all of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import normalize_prior
from ..functions.timing import gaussian_time, round3
from . import scoring
from .events import ALIAS_SCORE, name_pair_scores
from .lineage import cut
from .teams import map_teams

REASONS = {
    "TIME_WINDOW": "_always",
    "FS_MODEL": "_always",
    "CANDIDATE_PRIOR": "_prior_used",
    "STRONG_CONSTRAINT": "strong_constraint_ok",
    "DTW_OFFSET": "_shifted",
    "SIDE_REVERSED": "side_reversed",
    "ALIAS_HIT": "_alias_hit",
    "TEAM_ID_FALLBACK": "_anchor",
}
LEVEL, PRIOR, MODEL, REVERSED, ANCHOR, ALIAS = 0.82, 0.10, 0.08, 0.12, 0.08, 0.04
LEAST = 0.75
#: Edges that the sorted pass of one task takes at a time.
PASS = 100_000


def best_level(name: Column, gap: Column, reversed_: Column, strong: Column) -> Column:
    """struct(rule, score, time): the best of L1-L3, else L4 under a strong constraint, else L5 (R2); null if none."""
    options = []
    for i, (rule, sigma, most, least_name, w_time, w_name, least, alias) in enumerate(fixed.EVENT_LEVELS):
        if alias:
            continue
        near = gaussian_time(gap, sigma) if w_time else F.lit(0.0)
        score = F.lit(w_time) * near + F.lit(w_name) * name
        fits = (gap <= (86400 if most is None else most)) & (name >= least_name) & (score >= least)
        options.append(F.when(fits, F.struct(score.alias("score"), F.lit(-i).alias("first"), F.lit(rule).alias("rule"), near.alias("time"))))
    best = F.greatest(*options)
    late = gaussian_time(gap, 43200)
    kind = lambda rule, score, time: F.struct(rule.alias("rule"), score.alias("score"), time.alias("time"))
    return (
        F.when(best.isNotNull(), kind(best["rule"], best["score"], best["time"]))
        .when(strong & (name >= 0.85) & (gap <= 259200), kind(F.lit("EVENT_L4"), 0.80 + 0.10 * late, late))
        .when(~reversed_ & (name >= 0.90) & (gap <= 30 * 86400), kind(F.lit("EVENT_L5"), name, F.lit(0.0)))
    )


NAMES = (("_hf", "home_name", "target_home_name"), ("_af", "away_name", "target_away_name"), ("_hr", "home_name", "target_away_name"), ("_ar", "away_name", "target_home_name"))


def with_name_scores(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the name similarity of both teams to the target's, straight (_hf, _af) and crossed (_hr, _ar)."""
    every = [pairs.select(F.coalesce(F.col(a), F.lit("")).alias("x"), F.coalesce(F.col(b), F.lit("")).alias("y")) for _, a, b in NAMES]
    scores = cut(name_pair_scores(reduce(DataFrame.unionByName, every)))
    for out, a, b in NAMES:
        found = scores.toDF("_x", "_y", out)
        same = (F.coalesce(F.col(a), F.lit("")) == F.col("_x")) & (F.coalesce(F.col(b), F.lit("")) == F.col("_y"))
        pairs = pairs.join(found, same).drop("_x", "_y")
    return pairs


def estimated_offsets(pairs: DataFrame, pool: str | None = None) -> DataFrame:
    """(_pool, offset): seconds by which the targets of a pool of candidate pairs are late, where they are so steadily.

    ``pool`` is the column that tells pools apart; without one all pairs are one pool. A source event whose teams are those
    of exactly one target of its pool, within a week, is an anchor.
    """
    rows = pairs.select("*", (F.lit("") if pool is None else F.col(pool).cast("string")).alias("_pool")).dropDuplicates(["_pool", "event_id", "target_id"])
    name = F.greatest((F.col("_hf") + F.col("_af")) / 2, (F.col("_hr") + F.col("_ar")) / 2)
    gaps = with_name_scores(rows).select(F.col("_pool").alias("league_id"), F.col("event_id").alias("s"), F.col("target_id").alias("t"), (F.col("target_time") - F.col("start_unix")).alias("gap"), name.alias("name"))
    found = scoring.usable(scoring.offsets(scoring.anchors(gaps), ["league_id"]))
    return found.select(F.col("league_id").alias("_pool"), "offset")


def with_offsets(pairs: DataFrame, pool: str | None = None) -> DataFrame:
    """``pairs`` with ``offset`` as :func:`estimated_offsets` finds it for each pool, 0 where it finds none."""
    known = F.lit("") if pool is None else F.col(pool).cast("string")
    moved = pairs.drop("offset").withColumn("_at", known).join(cut(estimated_offsets(pairs, pool)), F.col("_at").eqNullSafe(F.col("_pool")), "left")
    return moved.withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long")).drop("_at", "_pool")


def edges(pairs: DataFrame, model: scoring.Model | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Scored edges of candidate pairs.

    ``aliases`` (s, t) are teams known to be the same: their names count as alike, and an edge that meets one is raised.
    A pair with a ``strong_constraint_reason`` that is not ok makes no edge.

    ``pairs`` has source columns (event_id, start_unix, home_id, home_name, away_id, away_name), target columns
    (target_id, target_time, target_home_id, ...), the candidate's priors and constraint, ``offset`` (seconds, 0 if none)
    and ``mapped_home``, ``mapped_away`` (the target teams that the source teams are mapped to, or null).
    """
    c = F.col
    if "strong_constraint_reason" in pairs.columns:
        pairs = pairs.filter(c("strong_constraint_ok") | (F.coalesce("strong_constraint_reason", F.lit("")) == ""))
    p = with_name_scores(pairs).withColumn("_alias_hit", F.lit(False))
    if aliases is not None:
        known = aliases.filter("s <> '' and t <> ''").groupBy("s").agg(F.collect_set("t").alias("t"))
        for own in ("home", "away"):
            p = p.join(known.toDF(f"{own}_id", f"_{own}_to"), f"{own}_id", "left")
        hit = lambda own, other: F.coalesce(F.array_contains(c(f"_{own}_to"), c(f"target_{other}_id")), F.lit(False))
        for out, own, other in (("_hf", "home", "home"), ("_af", "away", "away"), ("_hr", "home", "away"), ("_ar", "away", "home")):
            p = p.withColumn(out, F.when(hit(own, other), ALIAS_SCORE).otherwise(c(out)))
        p = p.withColumn("_alias_hit", reduce(lambda x, y: x | y, [hit(x, y) for x in ("home", "away") for y in ("home", "away")]))
    p = p.withColumn("side_reversed", (c("_hr") + c("_ar")) > (c("_hf") + c("_af")))
    pick = lambda straight, crossed: F.when(c("side_reversed"), c(crossed)).otherwise(c(straight))
    anchor = (c("mapped_home") == pick("target_home_id", "target_away_id")) & (c("mapped_away") == pick("target_away_id", "target_home_id"))
    p = (
        p.withColumn("_home", pick("_hf", "_hr"))
        .withColumn("_away", pick("_af", "_ar"))
        .withColumn("_name", (c("_home") + c("_away")) / 2)
        .withColumn("_anchor", F.coalesce(anchor, F.lit(False)))
        .withColumn("_shifted", c("offset") != 0)
        .withColumn("time_diff", F.abs(c("start_unix") + c("offset") - c("target_time")))
        .filter((c("_name") >= 0.40) | c("_anchor"))
        .withColumn("_level", best_level(c("_name"), c("time_diff"), c("side_reversed"), c("strong_constraint_ok")))
    )
    back = gaussian_time(c("time_diff"), 3600)
    by_id = F.when(c("_anchor"), F.struct(F.lit("EVENT_L4B").alias("rule"), (0.75 + 0.10 * back).alias("score"), back.alias("time")))
    p = p.withColumn("_level", F.coalesce("_level", by_id)).filter(c("_level").isNotNull())
    p = p.select("*", *scoring.compare(c("_home"), c("_away"), c("time_diff"), F.lit(True), F.lit(True), prefix="_fs_"))
    prior = normalize_prior(c("candidate_score"), c("home_team_candidate_score"), c("away_team_candidate_score"))
    p = p.withColumn("_fs", scoring.normalized(scoring.score(model or scoring.Model.default(), "_fs_"))).withColumn("_prior", prior)
    total = c("_level.score") * LEVEL + c("_prior") * PRIOR + c("_fs") * MODEL
    total = total - F.when(c("side_reversed"), REVERSED).otherwise(0.0) + F.when(c("_anchor"), ANCHOR).otherwise(0.0) + F.when(c("_alias_hit"), ALIAS).otherwise(0.0)
    p = p.withColumn("_always", F.lit(True)).withColumn("_prior_used", c("_prior") > 0)
    reasons = F.array_compact(F.array(*[F.when(c(flag), code) for code, flag in REASONS.items()]))
    return p.select(
        "event_id",
        "target_id",
        "competition_id",
        "home_id",
        "away_id",
        "target_home_id",
        "target_away_id",
        round3(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).alias("score"),
        c("_level.rule").alias("rule"),
        "time_diff",
        "side_reversed",
        reasons.alias("reasons"),
    )


def _sorted_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows, which come in order, whose source and target no row before has taken."""
    sources, targets = set(), set()
    for pdf in batches:
        won = []
        for s, t in zip(pdf["event_id"], pdf["target_id"], strict=True):
            won.append(s not in sources and t not in targets)
            if won[-1]:
                sources.add(s)
                targets.add(t)
        yield pdf[won]


def resolve(scored: DataFrame, least: float = LEAST, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(matches, conflicts): greedy one-to-one over all edges by score, source, target (R3). Edges below ``least`` are
    reported with the conflicts, without a winner.

    Edges that are first for both their source and their target are taken at once, and the edges of both ends fall away;
    repeated until no edge is left, this takes exactly the edges that the sorted greedy pass takes. Ties and chains can
    give one edge a round, so when ``rounds`` are over, or at most ``PASS`` edges are left, the first ``PASS`` edges of the
    order go through the sorted pass itself at a time, in one task. Each step is checkpointed to the shared folder.
    """
    order = [F.col("score").desc(), F.col("event_id"), F.col("target_id"), F.col("competition_id")]
    rest = cut(scored.filter(F.col("score") >= least))
    everything, taken, step = rest, None, 0
    while left := rest.count():
        if left <= PASS or step >= rounds:
            best = cut(rest.orderBy(*order).limit(PASS).mapInPandas(_sorted_pass, rest.schema))
        else:
            first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*order))
            best = cut(rest.withColumn("_s", first("event_id")).withColumn("_t", first("target_id")).filter("_s = 1 and _t = 1").drop("_s", "_t"))
        taken = best if taken is None else taken.unionByName(best)
        step += 1
        if step % 20 == 0:
            taken = cut(taken)
        for key in ("event_id", "target_id"):
            rest = rest.join(best.select(F.col(key).alias("_gone")), F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
        rest = cut(rest)
    if taken is None:
        taken = rest.limit(0)
    won = taken.select("event_id", "target_id", F.lit(True).alias("_won"))
    lost = everything.join(won, ["event_id", "target_id"], "left").filter("_won is null").drop("_won")
    by_source = taken.select("event_id", F.col("target_id").alias("_wt"), F.col("score").alias("_ws"))
    by_target = taken.select("target_id", F.col("event_id").alias("_we"), F.col("score").alias("_wts"))
    joined = lost.join(by_source, "event_id", "left").join(by_target, "target_id", "left")
    # what the sorted pass would say: the source first, if it was taken before the edge's turn
    before = (F.col("_ws") > F.col("score")) | ((F.col("_ws") == F.col("score")) & (F.col("_wt") < F.col("target_id")))
    source_first = F.coalesce(before, F.lit(False)) | F.col("_we").isNull()
    conflicts = joined.select(
        "event_id",
        "target_id",
        "score",
        F.when(source_first, F.col("event_id")).otherwise(F.col("_we")).alias("winner_event_id"),
        F.when(source_first, F.col("_wt")).otherwise(F.col("target_id")).alias("winner_target_id"),
        round3(F.when(source_first, F.col("_ws")).otherwise(F.col("_wts")) - F.col("score")).alias("gap"),
        F.when(source_first, "CONFLICT_SR_USED").otherwise("CONFLICT_TS_USED").alias("reason"),
    )
    low = scored.filter(F.coalesce(F.col("score") < least, F.lit(True)))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in conflicts.dtypes[3:6]]
    conflicts = conflicts.unionByName(low.select("event_id", "target_id", "score", *none, F.lit("BELOW_AUTO_THRESHOLD").alias("reason")))
    return taken, conflicts


def learned(matches: DataFrame) -> DataFrame:
    """(s, t, votes, confidence): the teams that resolved matches say are the same; sides that were swapped say nothing."""
    ballots = matches.filter(~F.col("side_reversed")).select(F.lit("").alias("league_id"), F.lit(True).alias("matched"), F.col("score").alias("confidence"), "home_id", "away_id", "target_home_id", "target_away_id")
    return map_teams(ballots).select("s", "t", "votes", "confidence")


def two_rounds(pairs: DataFrame, model: scoring.Model | None = None, pool: str | None = None, shifted: bool = False, aliases: DataFrame | None = None, learn: bool = False) -> tuple[DataFrame, DataFrame]:
    """Match, vote for teams, and match again with the mapped teams as anchors.

    With ``shifted`` the offset of each ``pool`` is estimated first. ``aliases`` (s, t) are known before the first round;
    with ``learn`` the second round reads those that the first has learned, too, as a relation of its own.
    """
    pairs = cut(with_offsets(pairs, pool) if shifted else pairs)
    first, _ = resolve(edges(pairs, model, aliases))
    teams = cut(learned(first))
    h, a = (teams.select("s", "t").toDF(f"{x}_id", f"mapped_{x}") for x in ("home", "away"))
    again = pairs.drop("mapped_home", "mapped_away").join(h, "home_id", "left").join(a, "away_id", "left")
    known = aliases
    if learn:
        new = teams.select("s", "t")
        known = new if aliases is None else aliases.select("s", "t").join(new, "s", "left_anti").unionByName(new)
    return resolve(edges(again, model, known))
