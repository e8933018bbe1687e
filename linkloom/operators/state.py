"""Knowledge kept between runs: alias stores and the validation log (A1-A4, V5-V8).

Rows are kept in a :class:`.store.Store`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

KEY = ["side", "src_id", "ts_id"]
COLUMNS = "side string, src_id string, ts_id string, sport string, votes bigint, confidence double, last_seen bigint, origin string"


def alias_store(spark, path: str) -> Store:
    """The store of team aliases; the aliases of a source team are in one bucket."""
    return Store(spark, path, COLUMNS, ["side", "src_id"])


def learn(store: Store, new: DataFrame) -> int:
    """Merge newly seen aliases into the store (A1, W2), whoever else writes to it; the version that has them."""
    return store.merge(new, upsert)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` merged in (A1): votes add up, the newest confidence and time stay (of rows of one
    time, those of the highest confidence)."""
    both = old.unionByName(new)
    newest = F.max_by(F.struct("sport", "confidence", "origin"), F.struct("last_seen", "confidence", "sport", "origin"))
    merged = both.groupBy(*KEY).agg(F.sum("votes").alias("votes"), F.max("last_seen").alias("last_seen"), newest.alias("x"))
    return merged.select(*KEY, "x.sport", "votes", "x.confidence", "last_seen", "x.origin")


def best_aliases(rows: DataFrame, least_votes: int = 2) -> DataFrame:
    """The alias of each source with the most votes, then the latest (A2)."""
    w = Window.partitionBy("side", "src_id").orderBy(F.col("votes").desc(), F.col("last_seen").desc(), "ts_id")
    return rows.filter(F.col("votes") >= least_votes).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prune(rows: DataFrame, as_of: int, days: int = 90) -> DataFrame:
    """Without single votes older than ``days`` (A3)."""
    return rows.filter(~((F.col("votes") == 1) & (F.col("last_seen") < as_of - days * 86400)))


def store_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sport").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"), F.count_if(F.col("votes") >= 2).alias("trusted"))


def best_league_aliases(rows: DataFrame) -> DataFrame:
    """Manual entries beat learned ones, which need two votes (A4)."""
    manual = F.col("origin") == "manual"
    w = Window.partitionBy("side", "src_id").orderBy(manual.desc(), F.col("votes").desc(), F.col("last_seen").desc(), "ts_id")
    return rows.filter(manual | (F.col("votes") >= 2)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


# --- validation of known maps ------------------------------------------------------------------------------------------


def reverse_confirm(matches: DataFrame, group: list[str], target_totals: DataFrame | None = None) -> DataFrame:
    """Reverse-confirm rates (V3): as observed (over distinct matched targets) and, with totals, as documented."""
    ok = F.col("matched")
    rows = matches.groupBy(*group).agg(F.count("*").alias("n_source"), F.count_if(ok).alias("n_matched"), F.countDistinct(F.when(ok, F.col("target_id"))).alias("n_target_matched"))
    low = F.least("n_source", "n_target_matched")
    rows = rows.withColumn("rcr_observed", F.when(low > 0, F.col("n_matched") / low).otherwise(0.0))
    if target_totals is None:
        return rows
    least = F.least("n_source", "n_target")
    return rows.join(target_totals, group).withColumn("rcr_documented", F.when(least > 0, F.col("n_matched") / least).otherwise(0.0))


def rcr_level(rate: Column) -> Column:
    return F.when(rate >= 0.60, "HIGH").when(rate >= 0.40, "MEDIUM").when(rate >= 0.30, "LOW").otherwise("FAIL")


def rcr_bonus(rate: Column) -> Column:
    return F.when(rate >= 0.60, 0.10).when(rate >= 0.40, 0.05).when(rate >= 0.30, 0.02).otherwise(0.0)


def validate_known(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Status and confidence of known-map entries (V5): rows have (key, n_events, rcr)."""
    marked = rows.join(overrides.select("key", F.lit(True).alias("_o")), "key", "left")
    status = F.when(F.col("_o"), "OVERRIDE").when(F.col("n_events") < 5, "INSUFFICIENT").when(F.col("rcr") < 0.30, "SUSPECT").otherwise("OK")
    return marked.withColumn("status", status).withColumn("confidence", F.when(F.col("status") == "SUSPECT", 0.8).otherwise(1.0)).drop("_o")


def newest(log: DataFrame, keys: list[str], time: str, tie: str, n: int = 100) -> DataFrame:
    """The newest n rows of each key (V6)."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def recent_mean(log: DataFrame, n: int = 10) -> DataFrame:
    """Mean rate of the last n judged rows of each key, and whether the last one is suspect (V8)."""
    judged = log.filter(~F.col("status").isin("OVERRIDE", "INSUFFICIENT"))
    last = newest(judged, ["key"], "at", "seq", n)
    return last.groupBy("key").agg(F.avg("rcr").alias("mean_rcr"), (F.max_by("status", F.struct("at", "seq")) == "SUSPECT").alias("suspect"))


def set_override(overrides: DataFrame, keys: DataFrame, on: bool = True) -> DataFrame:
    """Keys marked or cleared (V7)."""
    rest = overrides.join(keys, "key", "left_anti")
    return rest.unionByName(keys.select("key")) if on else rest
