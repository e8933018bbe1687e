"""Match statistics, evaluation and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ["EVENT_L1", "EVENT_L2", "EVENT_L3", "EVENT_L4", "EVENT_L5", "EVENT_L4B", "EVENT_L6"]


def match_stats(matches: DataFrame, group: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """Totals, matched, rate, mean confidence and a count per level (V1, V2)."""
    ok = F.col("matched")
    levels = [F.count_if(ok & (F.col("rule") == r)).alias(f"n_{r.lower()}") for r in rules or RULES]
    rows = matches.groupBy(*(group or [])).agg(F.count("*").alias("total"), F.count_if(ok).alias("n_matched"), F.avg(F.when(ok, F.col("confidence"))).alias("avg_confidence"), *levels)
    rate = F.when(F.col("total") > 0, F.floor(F.col("n_matched") / F.col("total") * 1000 + 0.5) / 1000).otherwise(0.0)
    return rows.withColumn("rate", rate).withColumn("avg_confidence", F.coalesce(F.floor(F.col("avg_confidence") * 1000 + 0.5) / 1000, F.lit(0.0)))


def rule_counts(matches: DataFrame, group: list[str]) -> DataFrame:
    """A column per rule (K6)."""
    return matches.groupBy(*group).pivot("rule", [*RULES, "EVENT_NO_MATCH"]).count().na.fill(0)


def precision_recall(predicted: DataFrame, truth: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of predicted pairs against true ones (V9)."""
    g = group or []
    p = predicted.select(*g, *keys, F.lit(1).alias("_p")).distinct()
    t = truth.select(*g, *keys, F.lit(1).alias("_t")).distinct()
    both = p.join(t, [*g, *keys], "full")
    sums = both.groupBy(*g).agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count("_p").alias("n_predicted"), F.count("_t").alias("n_true"))
    pr = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(0.0)
    rc = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    rows = sums.withColumn("precision", pr).withColumn("recall", rc)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.withColumn("f1", f1)


def weighted_means(scores: DataFrame, weight: str, group: list[str] | None = None) -> DataFrame:
    """Means of precision, recall and F1 weighted by the number of true pairs."""
    mean = lambda c: (F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c)
    return scores.groupBy(*(group or [])).agg(mean("precision"), mean("recall"), mean("f1"))


def merge_truth(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and of ``second`` those whose key it lacks."""
    return first.unionByName(second.join(first, keys, "left_anti").select(*first.columns))


def score_histogram(truth: DataFrame, width: float = 0.1) -> DataFrame:
    return truth.groupBy((F.floor(F.col("score") / width) * width).alias("bin")).count().orderBy("bin")


def sport_summary(matches: DataFrame) -> DataFrame:
    """Per sport, with leagues played on a screen apart."""
    return match_stats(matches, ["sport", "is_virtual"])


def with_totals(stats: DataFrame, label: str) -> DataFrame:
    """A grand-total row under per-group statistics (K3): counts add up, the rate is that of the sums, and the mean
    confidence weighs each group by its matches."""
    numbers = [c for c, k in stats.dtypes if k in ("bigint", "int") and c != label]
    parts = [F.sum(c).alias(c) for c in numbers]
    if {"avg_confidence", "n_matched"} <= set(stats.columns):
        parts.append(F.sum(F.col("avg_confidence") * F.col("n_matched")).alias("_weight"))
    total = stats.agg(*parts).withColumn(label, F.lit("TOTAL"))
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000
    if {"rate", "n_matched", "total"} <= set(stats.columns):
        total = total.withColumn("rate", F.when(F.col("total") > 0, three(F.col("n_matched") / F.col("total"))).otherwise(0.0))
    if "_weight" in total.columns:
        total = total.withColumn("avg_confidence", F.when(F.col("n_matched") > 0, three(F.col("_weight") / F.col("n_matched"))).otherwise(0.0)).drop("_weight")
    return stats.unionByName(total, allowMissingColumns=True)
