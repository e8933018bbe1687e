"""Scans of provider tables into canonical frames, and a registry of sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timing import dob_of_seconds, parse_iso, sport_of
from ..schema import assert_schema, canonical

SNAPSHOT = "Body struct<Fixtures:array<struct<Participants:array<struct<Id:string,Name:string,Players:array<struct<Id:string,Name:string>>>>>>>"


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the first in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def tournaments(leagues: DataFrame, categories: DataFrame, source: str) -> DataFrame:
    """Leagues of the text-id providers with their category's name (S2, S12, S18); a category that repeats counts once."""
    names = categories.groupBy("category_id").agg(F.min("name").alias("category_name"))
    sport = sport_of(F.col("sport_id").cast("string"), source)
    joined = leagues.join(names, "category_id", "left")
    return canonical(joined.select(F.col("tournament_id").alias("id"), "name", sport.alias("sport"), "category_name", F.lit(source).alias("source")), "tournaments")


def competitions(by_sport: dict[str, DataFrame]) -> DataFrame:
    """Target leagues of all sports; a sport without countries has '' (S6, S7, S18)."""
    out = None
    for sport, df in by_sport.items():
        country = F.col("host_country") if "host_country" in df.columns else F.lit("")
        rows = canonical(df.select(F.col("competition_id").alias("id"), "name", F.lit(sport).alias("sport"), country.alias("category_name"), F.lit("ts").alias("source")), "tournaments")
        out = rows if out is None else out.unionByName(rows)
    return out


def events(raw: DataFrame, competitors: DataFrame, source: str, since: int | None = None) -> DataFrame:
    """Events of a text-time provider with both team names (S3, S13, S21): repeated ids keep the first by time."""
    id_col = "sport_event_id" if "sport_event_id" in raw.columns else "event_id"
    rows = raw.select(
        F.col(id_col).cast("string").alias("id"),
        F.col("tournament_id").cast("string").alias("tournament_id"),
        parse_iso(F.col("scheduled"), strip_zone=source == "ls").alias("start_unix"),
        F.col("home_competitor_id").cast("string").alias("home_id"),
        F.col("away_competitor_id").cast("string").alias("away_id"),
        "status_code",
    )
    rows = first_rows(rows, "id", "start_unix", "tournament_id")
    if since is not None:
        rows = rows.filter(F.col("start_unix") >= since)
    return canonical(_named(rows, competitors, "competitor_id").withColumn("source", F.lit(source)), "events")


def target_events(matches: DataFrame, teams: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Target matches in [since, until) with both team names (S8, S11, S19): bounds are parameters, never the clock."""
    rows = matches.select(
        F.col("match_id").alias("id"), F.col("competition_id").alias("tournament_id"), F.col("match_time").alias("start_unix"),
        F.col("home_team_id").alias("home_id"), F.col("away_team_id").alias("away_id"), F.col("status_id").alias("status_code"),
    )
    if since is not None:
        rows = rows.filter(F.col("start_unix") >= since)
    if until is not None:
        rows = rows.filter(F.col("start_unix") < until)
    return canonical(_named(rows, teams, "team_id").withColumn("source", F.lit("ts")), "events")


def _named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    n = names.select(F.col(key).cast("string").alias("_id"), F.col("name").alias("_name"))
    for side in ("home", "away"):
        rows = rows.join(n.toDF(f"{side}_id", f"{side}_name"), f"{side}_id", "left")
    return rows


def team_names(rows: DataFrame) -> DataFrame:
    """Distinct teams of events by league: both sides exploded, so no OR-join."""
    side = lambda s: F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_name").alias("name"))
    return rows.select("tournament_id", "source", F.explode(F.array(side("home"), side("away"))).alias("t")).select("tournament_id", "t.id", "t.name", "source").filter("id <> ''").distinct()


def team_players(competitors: DataFrame, players: DataFrame) -> DataFrame:
    """Players of teams whose rows list player ids as JSON text; a full name that only repeats the name is dropped."""
    ids = competitors.select("competitor_id", F.explode(F.from_json("player_ids", "array<string>")).alias("player_id"))
    full = F.when(F.col("full_name") != F.col("name"), F.col("full_name"))
    joined = ids.join(players, "player_id")
    return canonical(
        joined.select(F.col("player_id").alias("id"), F.coalesce(F.nullif(full, F.lit("")), "name").alias("name"), full.alias("full_name"), F.col("date_of_birth").alias("birthday"), "nationality", F.col("competitor_id").alias("team_id"), F.lit("sr").alias("source")),
        "players",
    )


def target_players(players: DataFrame) -> DataFrame:
    """One row per team, name and birthday; birthdays in seconds become dates."""
    rows = players.withColumn("birthday", dob_of_seconds(F.col("birthday").cast("string")))
    w = Window.partitionBy("team_id", "name", "birthday").orderBy("player_id")
    rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return canonical(rows.withColumnRenamed("player_id", "id").withColumn("source", F.lit("ts")), "players")


def snapshot_players(spark: SparkSession, path: str) -> DataFrame:
    """Players from saved snapshot documents, nested three deep."""
    raw = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    teams = raw.select(F.explode("Body.Fixtures").alias("f")).select(F.explode("f.Participants").alias("p"))
    rows = teams.select(F.col("p.Id").alias("team_id"), F.explode("p.Players").alias("x")).select("team_id", F.col("x.Id").alias("id"), F.col("x.Name").alias("name"))
    return canonical(rows.dropDuplicates(["team_id", "id"]).withColumn("source", F.lit("ls")), "players")


def league_counts(leagues: DataFrame, rows: DataFrame, year: str) -> DataFrame:
    """Leagues with the number of different events in a year; joins may fan out, so ids are counted once."""
    found = rows.filter(F.col("scheduled").startswith(year)).groupBy("tournament_id").agg(F.countDistinct("event_id").alias("event_count"))
    return leagues.join(found, "tournament_id").orderBy(F.col("event_count").desc(), "tournament_id")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Source:
    """How one provider's tables become canonical frames."""

    name: str
    load: dict[str, Callable[[SparkSession], DataFrame]]


class Registry:
    """Sources by tag."""

    def __init__(self):
        self._sources: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        self._sources[source.name] = source

    def names(self) -> list[str]:
        return sorted(self._sources)

    def load(self, spark: SparkSession, name: str, entity: str) -> DataFrame:
        if name not in self._sources:
            raise KeyError(f"no source {name!r}; known: {', '.join(self.names())}")
        return assert_schema(self._sources[name].load[entity](spark), entity)
