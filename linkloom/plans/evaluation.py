"""Offline evaluation (W6): match every league and hold the matches against known pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import offline, reports
from ..operators.lineage import cut

#: A known pair, with what is known of its target.
TRUTH = (
    "league_id string, event_id string, target_id string, target_time bigint, target_home_id string, target_home_name string, "
    "target_away_id string, target_away_name string"
)


def target_events(leagues: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """Target events by league with their ``origin``: those of its competition or, where there are none, those of its known pairs.

    ``leagues`` has (league_id, competition_id), ``targets`` canonical events with competition_id.
    """
    sides = ["home_id", "home_name", "away_id", "away_name"]
    linked = leagues.filter("competition_id <> ''")
    own = targets.join(linked, "competition_id").select("league_id", "event_id", "start_unix", *sides, F.lit("file").alias("origin"))
    rebuilt = truth.join(linked, "league_id", "left_semi").join(own.select("league_id").distinct(), "league_id", "left_anti")
    made = rebuilt.select("league_id", F.col("target_id").alias("event_id"), F.col("target_time").alias("start_unix"), *[F.col(f"target_{c}").alias(c) for c in sides], F.lit("truth").alias("origin"))
    return own.unionByName(made.distinct())


def evaluate(leagues: DataFrame, events: DataFrame, targets: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, statistics a league): counts, rate, mean confidence, matches by level, precision, recall, F1 and a note.

    A league without source or target events is reported with a note and without matches.
    """
    found = cut(target_events(leagues, targets, truth))
    named = leagues.select("league_id").distinct()
    source = events.join(named, "league_id", "left_semi")
    both = source.join(found.select("league_id").distinct(), "league_id", "left_semi")
    matches = cut(offline.match_offline(both, found))
    good = matches.filter("matched")
    scores = reports.precision_recall(good, truth, ["event_id", "target_id"], ["league_id"]).drop("n_predicted")
    counts = source.groupBy("league_id").agg(F.count("*").alias("n_source"))
    seen = found.groupBy("league_id").agg(F.count("*").alias("n_target"), F.first("origin").alias("origin"))
    rows = named
    for part in (counts, seen, reports.match_stats(matches, ["league_id"]).drop("total"), scores):
        rows = rows.join(part, "league_id", "left")
    numbers = [c for c, k in rows.dtypes if k in ("bigint", "int", "double")]
    rows = rows.fillna(0, numbers)
    note = F.when(F.col("n_source") == 0, "no source events").when(F.col("n_target") == 0, "no target events").otherwise(F.col("origin"))
    return matches, rows.withColumn("note", note).drop("origin")
