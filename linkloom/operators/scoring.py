"""Fellegi-Sunter comparison and fitting (X1-X4), and time-offset correction."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .store import Store

LEVELS = ("disagree", "partial", "agree")
FLOOR = 1e-10


def compare(home: Column, away: Column, gap: Column, same_tier: Column, same_sport: Column, prefix: str = "") -> list[Column]:
    """Five levels (0 disagree, 1 partial, 2 agree) of a pair of events."""
    name = lambda s: F.when(s >= 0.80, 2).when(s >= 0.50, 1).otherwise(0)
    time = F.when(F.abs(gap) <= 1800, 2).when(F.abs(gap) <= 21600, 1).otherwise(0)
    yes = lambda b: F.when(b, 2).otherwise(0)
    return [c.cast("tinyint").alias(prefix + n) for c, n in zip((name(home), name(away), time, yes(same_tier), yes(same_sport)), fixed.FS_FIELDS, strict=True)]


@dataclass
class Model:
    """Chances of each field's levels (disagree, partial, agree) for matches and others.

    With ``compat`` the priors are indexed the other way round, as the observed service does.
    """

    match: list = field(default_factory=lambda: [tuple(reversed(x)) for x in fixed.FS_MATCH])
    other: list = field(default_factory=lambda: [tuple(reversed(x)) for x in fixed.FS_OTHER])
    prior: float = 0.05

    @classmethod
    def default(cls, compat: bool = False) -> Model:
        return cls(list(fixed.FS_MATCH), list(fixed.FS_OTHER)) if compat else cls()


def score(model: Model, prefix: str = "") -> Column:
    """Sum over the fields of log2(m / u)."""
    total = F.lit(0.0)
    for name, m, u in zip(fixed.FS_FIELDS, model.match, model.other, strict=True):
        out = F.when(F.lit(False), 0.0)
        for level in range(3):
            out = out.when(F.col(prefix + name) == level, math.log2(max(m[level], FLOOR) / max(u[level], FLOOR)))
        total = total + out
    return total


def normalized(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value / 3.0))


def classify(value: Column, high: float = 6.0, low: float = -2.0) -> Column:
    return F.when(value >= high, 2).when(value >= low, 1).otherwise(0)


def fit(pairs: DataFrame, model: Model | None = None, steps: int = 100, tolerance: float = 1e-4, laplace: float = 0.01) -> Model:
    """Expectation-maximisation on level patterns (X3): pairs are counted by pattern first, at most 3^5 rows."""
    model = model or Model.default()
    rows = [tuple(r) for r in pairs.groupBy(*fixed.FS_FIELDS).count().collect()]
    return fit_patterns(rows, model, steps, tolerance, laplace)


def fit_patterns(rows: list[tuple], model: Model, steps: int = 100, tolerance: float = 1e-4, laplace: float = 0.01) -> Model:
    if not rows:
        return model
    levels = np.asarray([r[:5] for r in rows], dtype=int)
    n = np.asarray([r[5] for r in rows], dtype=float)
    m, u, prior = np.asarray(model.match, dtype=float), np.asarray(model.other, dtype=float), 0.05
    at = np.arange(5)
    before = -math.inf
    for _ in range(steps):
        yes = math.log(prior) + np.log(np.maximum(m[at, levels], FLOOR)).sum(axis=1)
        no = math.log(1 - prior) + np.log(np.maximum(u[at, levels], FLOOR)).sum(axis=1)
        top = np.maximum(yes, no)
        both = top + np.log(np.exp(yes - top) + np.exp(no - top))
        post = np.exp(yes - both)
        likelihood = float((n * both).sum())
        prior = min(max(float((n * post).sum() / n.sum()), 1e-6), 1 - 1e-6)
        for weights, table in ((n * post, m), (n * (1 - post), u)):
            for f in range(5):
                sums = np.asarray([weights[levels[:, f] == k].sum() for k in range(3)]) + laplace
                table[f] = sums / sums.sum()
        if abs(likelihood - before) < tolerance:
            break
        before = likelihood
    return Model([tuple(x) for x in m], [tuple(x) for x in u], prior)


#: Stored counts of level patterns of a league: all that a fit needs of the comparisons, at most 3^5 rows a league.
COUNTS = "league_id string, " + ", ".join(f"{f} int" for f in fixed.FS_FIELDS) + ", n bigint"
MODELS = "league_id string, field string, level int, m double, u double, prior double"


def pattern_counts(pairs: DataFrame) -> DataFrame:
    """(league_id, levels, n) of comparisons (COUNTS)."""
    return pairs.groupBy("league_id", *[F.col(f).cast("int").alias(f) for f in fixed.FS_FIELDS]).agg(F.count("*").alias("n"))


def fit_counts(counts: DataFrame, least: int = 5) -> DataFrame:
    """The model (MODELS) of each league whose pattern counts add up to ``least`` or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if pdf["n"].sum() >= least:
            pdf = pdf.sort_values(list(fixed.FS_FIELDS))
            fitted = fit_patterns([tuple(r) for r in pdf[[*fixed.FS_FIELDS, "n"]].itertuples(index=False)], Model.default())
            rows = [(pdf["league_id"].iloc[0], f, k, fitted.match[i][k], fitted.other[i][k], fitted.prior) for i, f in enumerate(fixed.FS_FIELDS) for k in range(3)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MODELS.split(", ")])

    return counts.groupBy("league_id").applyInPandas(run, MODELS)


def fit_leagues(pairs: DataFrame, least: int = 5) -> DataFrame:
    """The model (MODELS) of each league with ``least`` comparisons or more."""
    return fit_counts(pattern_counts(pairs), least)


def model_store(spark, path: str) -> Store:
    """The store of leagues' pattern counts; the counts of a league are in one bucket."""
    return Store(spark, path, COUNTS, ["league_id"])


def learn(store: Store, pairs: DataFrame, least: int = 5) -> int:
    """Add the comparisons of a run to the stored counts of their leagues (X4); a league with fewer than ``least`` waits for more.

    Counts add up, so models fitted on the store are those of a fit on all comparisons that it has been given.
    """
    new = pattern_counts(pairs)
    enough = new.groupBy("league_id").agg(F.sum("n").alias("_all")).filter(F.col("_all") >= least).select("league_id")
    key = ["league_id", *fixed.FS_FIELDS]
    return store.merge(new.join(enough, "league_id", "left_semi"), lambda old, more: old.unionByName(more).groupBy(*key).agg(F.sum("n").alias("n")))


def stored_models(store: Store) -> DataFrame:
    """The model (MODELS) of each league in the store."""
    return fit_counts(store.read())


def score_by_league(pairs: DataFrame, models: DataFrame, default: Model | None = None, prefix: str = "") -> DataFrame:
    """``pairs`` with ``score`` (X2) under the model of their league, or the default where the league has none."""
    weight = F.log2(F.greatest("m", F.lit(FLOOR)) / F.greatest("u", F.lit(FLOOR)))
    name = F.concat_ws(":", "field", F.col("level").cast("string"))
    known = models.groupBy(F.col("league_id").alias("_l")).agg(F.map_from_entries(F.collect_list(F.struct(name, weight))).alias("_w"))  # 15 numbers a league
    own = F.lit(0.0)
    for f in fixed.FS_FIELDS:
        own = own + F.coalesce(F.try_element_at("_w", F.concat_ws(":", F.lit(f), F.col(prefix + f).cast("string"))), F.lit(0.0))
    joined = pairs.join(known, F.col("league_id") == F.col("_l"), "left")
    return joined.withColumn("score", F.when(F.col("_w").isNotNull(), own).otherwise(score(default or Model.default(), prefix))).drop("_l", "_w")


# --- offsets -----------------------------------------------------------------------------------------------------------


def anchors(pairs: DataFrame, least: float = 0.85, most: int = 7 * 86400) -> DataFrame:
    """Source events with exactly one target of ``name`` >= least, if that is within a week (D1): pairs (league_id, s, t, gap, name).

    ``gap`` is the target's time less the source's. A second target with such a name makes the event ambiguous, however
    far away it is.
    """
    good = pairs.filter(F.col("name") >= least)
    one = good.groupBy("league_id", "s").agg(F.count("*").alias("n"), F.first("t").alias("t"), F.first("gap").alias("gap"), F.first("name").alias("name"))
    return one.filter((F.col("n") == 1) & (F.abs("gap") <= most)).drop("n")


def offsets(gaps: DataFrame, group: list[str], gap: str = "gap") -> DataFrame:
    """Median offset (truncated to a whole second), mean absolute deviation from it and validity, per group."""
    mid = gaps.groupBy(*group).agg(F.expr(f"cast(percentile({gap}, 0.5) as bigint)").alias("offset"), F.count("*").alias("n"))
    joined = gaps.join(mid, group)
    dev = joined.groupBy(*group, "offset", "n").agg(F.expr(f"cast(percentile(abs({gap} - offset), 0.5) as bigint)").alias("mad"))
    return dev.withColumn("valid", F.col("n") >= 3)


def usable(offset: DataFrame, most_mad: int = 21600, least: int = 300) -> DataFrame:
    """Offsets that are valid, steady and large enough to be used (D3)."""
    return offset.filter(F.col("valid") & (F.col("mad") <= most_mad) & (F.abs("offset") >= least))


def corrected(events: DataFrame, offset: DataFrame, most_mad: int = 21600, least: int = 300) -> DataFrame:
    """Source times moved to the targets' by their league's offset where it is usable (D3)."""
    use = usable(offset, most_mad, least).select("league_id", F.col("offset").alias("_o"))
    moved = F.col("start_unix") + F.coalesce("_o", F.lit(0))
    return events.join(use, "league_id", "left").withColumn("start_unix", moved).withColumn("offset_applied", F.coalesce("_o", F.lit(0))).drop("_o")
