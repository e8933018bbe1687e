"""Which leagues and events a run is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import first_rows


def events_of_pairs(events: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """Canonical events of (tournament_id, home_id, away_id) in that order of sides, the ``most`` earliest of each by (time, id)."""
    keys = ["tournament_id", "home_id", "away_id"]
    met = events.join(wanted.select(*keys).distinct(), keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("start_unix", "id"))
    return met.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n").select(events.columns)


def leagues_of_sport(leagues: DataFrame, categories: DataFrame, sport_id: str) -> DataFrame:
    """(tournament_id, name, location) of a sport's leagues, each combination once; a category of another sport is none."""
    named = categories.filter(F.col("sport_id").cast("string") == sport_id).select("category_id", F.col("name").alias("location"))
    rows = leagues.filter(F.col("sport_id").cast("string") == sport_id).join(named, "category_id", "left")
    return rows.select("tournament_id", "name", F.coalesce("location", F.lit("")).alias("location")).distinct()


def year_counts(events: DataFrame, year: str) -> DataFrame:
    """(tournament_id, event_count): different events of each league in a year, ids compared as text."""
    rows = events.filter(F.col("scheduled").startswith(year)).filter(F.col("tournament_id").isNotNull())
    return rows.groupBy(F.col("tournament_id").cast("string").alias("tournament_id")).agg(F.countDistinct("event_id").alias("event_count"))


def top_leagues(leagues: DataFrame, events: DataFrame, year: str, tops: dict[str, int]) -> DataFrame:
    """(tournament_id, sport_id, event_count, place) of the leagues with most events in a year, so many of each sport.

    Of equal counts the smaller id comes first.
    """
    keyed = leagues.select(F.col("tournament_id").cast("string").alias("tournament_id"), F.col("sport_id").cast("string").alias("sport_id"))
    keyed = keyed.filter(F.col("sport_id").isin(*tops)).distinct()
    place = F.row_number().over(Window.partitionBy("sport_id").orderBy(F.col("event_count").desc(), "tournament_id"))
    most = F.lit(0)
    for sport, n in sorted(tops.items()):
        most = F.when(F.col("sport_id") == sport, n).otherwise(most)
    return year_counts(events, year).join(keyed, "tournament_id").withColumn("place", place).filter(F.col("place") <= most).select("tournament_id", "sport_id", "event_count", "place")


def target_leagues(hot: DataFrame, mapped: DataFrame, leagues: DataFrame, categories: DataFrame, events: DataFrame, year: str, tops: dict[str, int]) -> DataFrame:
    """The leagues that a run is about: hot ones not deleted, mapped ones, and those with most events of a year.

    Each league of ``leagues`` once, with its category's name, whether it is hot, whether it is mapped, and its number
    of events in the year. Empty ids and ids without a league are left out.
    """
    ids = lambda df, c="tournament_id": df.select(F.col(c).cast("string").alias("tournament_id")).filter("tournament_id <> ''").distinct()
    hot_ids = ids(hot.filter(F.coalesce(F.col("is_deleted").cast("int"), F.lit(0)) == 0)).withColumn("_hot", F.lit(True))
    mapped_ids = ids(mapped).withColumn("_mapped", F.lit(True))
    wanted = hot_ids.join(mapped_ids, "tournament_id", "full").join(ids(top_leagues(leagues, events, year, tops)), "tournament_id", "full")
    rows = leagues.select(F.col("tournament_id").cast("string").alias("tournament_id"), "name", "sport_id", "category_id")
    rows = first_rows(rows, "tournament_id", "name", "sport_id", "category_id")
    named = categories.groupBy("category_id").agg(F.min("name").alias("category_name"))
    found = rows.join(wanted, "tournament_id").join(named, "category_id", "left").join(year_counts(events, year), "tournament_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return found.select(
        "tournament_id", F.coalesce("name", F.lit("")).alias("name"), "sport_id", "category_id", F.coalesce("category_name", F.lit("")).alias("category_name"),
        flag(F.col("_hot")).alias("is_hot"), flag(F.col("_mapped")).alias("has_mapping"), F.coalesce("event_count", F.lit(0)).alias("event_count"),
    )
