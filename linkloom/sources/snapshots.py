"""Snapshots of a provider as a data source, and players by table with snapshots behind it.

``spark.read.format("fixture_snapshots")`` gives one row for each player of each participant of each fixture. Documents are saved
files under ``path`` (a folder or a file, on any file system that Arrow reads) or the answers of the comma-separated ``urls``, to which
``body`` is posted. Files are read by several tasks, about ``bytes`` of them in each. Filters on ``team_id`` and ``document`` reach
the source: files of other names are not opened, players of other teams not made into rows.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..schema import canonical

FORMAT = "fixture_snapshots"
SCHEMA = "document string, place bigint, team_id string, team_name string, id string, name string"
#: Seconds that an answer may take, and how often a call is made before it counts as failed.
WAIT, TRIES = 60, 3
#: Rows of a batch that a task hands over.
ROWS = 10_000


@dataclass
class Documents(InputPartition):
    """The documents of one task: (name, whether it is a file)."""

    names: list[tuple[str, bool]]

    def __post_init__(self):
        super().__init__(self.names)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _text(value) -> str:
    """An id or name as text; 0, null and missing ones are ''."""
    return "" if value in (None, 0, "0") else str(value)


def players_of(document: dict, teams: set[str] | None) -> Iterator[tuple[int, str, str, str, str]]:
    """(place, team, its name, player, its name) in the order of the document; those without id or name are left out."""
    place = 0
    for fixture in (document.get("Body") or {}).get("Fixtures") or []:
        for team in fixture.get("Participants") or []:
            team_id = _text(team.get("Id"))
            for player in team.get("Players") or []:
                place += 1
                found = _text(player.get("Id")), player.get("Name") or ""
                if all(found) and (teams is None or team_id in teams):
                    yield place, team_id, team.get("Name") or "", *found


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.body = options.get("path"), options.get("body", "{}")
        self.urls = [u.strip() for u in options.get("urls", "").split(",") if u.strip()]
        self.bytes = int(options.get("bytes", 128 << 20))
        self.teams: set[str] | None = None
        self.documents: set[str] | None = None
        if not self.path and not self.urls:
            raise ValueError(f"{FORMAT} needs the option path or urls")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is the interface's
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else ""
            if name not in ("team_id", "document"):
                yield f
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            field = "teams" if name == "team_id" else "documents"
            before = getattr(self, field)
            setattr(self, field, wanted if before is None else before & wanted)

    def partitions(self) -> list[Documents]:
        wanted = lambda name: self.documents is None or name in self.documents
        out = [Documents([(u, False)]) for u in self.urls if wanted(u)]
        if self.path:
            files, at = _file_system(self.path)
            info = files.get_file_info(at)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            listed = [info] if info.is_file else files.get_file_info(fs.FileSelector(at, recursive=True))
            names = sorted((f.path, f.size) for f in listed if f.is_file and f.base_name.endswith(".json") and wanted(f.path))
            held = 0
            for name, size in names:
                if not held or held + size > self.bytes:
                    out.append(Documents([]))
                    held = 0
                out[-1].names.append((name, True))
                held += max(size, 1)
        return out or [Documents([])]

    def _load(self, name: str, is_file: bool) -> dict:
        if is_file:
            with _file_system(self.path)[0].open_input_stream(name) as stream:
                return self._parsed(name, stream.read())
        for tried in range(TRIES):
            try:
                call = urllib.request.Request(name, data=self.body.encode(), headers={"Content-Type": "application/json"}, method="POST")
                with urllib.request.urlopen(call, timeout=WAIT) as answer:
                    return self._parsed(name, answer.read())
            except OSError:
                if tried == TRIES - 1:
                    raise
                time.sleep(2**tried)
        raise AssertionError("unreachable")

    @staticmethod
    def _parsed(name: str, data: bytes) -> dict:
        try:
            return json.loads(data)
        except ValueError as e:
            raise ValueError(f"{name} is no JSON document: {e}") from e

    def read(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        columns = [c.split() for c in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in columns])
        rows: list[tuple] = []
        for name, is_file in partition.names:
            for row in players_of(self._load(name, is_file), self.teams):
                rows.append((name, *row))
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)


def snapshots(spark: SparkSession, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(**options).load()


def players(rows: DataFrame) -> DataFrame:
    """Each team's players once, by the name that stands first in the first document."""
    first = rows.groupBy("team_id", "id").agg(F.min_by("name", F.struct("document", "place")).alias("name"))
    return canonical(first.withColumn("source", F.lit("ls")), "players")


def players_by_table(spark: SparkSession, name: str) -> DataFrame | None:
    """Players with an id and a name from a table that need not exist: (player_id, name, competitor_id)."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.table(name).select(F.col("player_id").cast("string").alias("id"), "name", F.col("competitor_id").cast("string").alias("team_id"))
    return canonical(rows.filter("id <> '' AND name <> ''").withColumn("source", F.lit("ls")), "players")


def players_of_teams(spark: SparkSession, teams: DataFrame, table: str, rows: DataFrame, whole: bool = False) -> DataFrame:
    """Players of ``teams`` (team_id) from the table, and from snapshots ``rows`` for teams that have none there.

    ``whole``: from snapshots for all teams, but only where the table has nobody of any of them.
    """
    wanted = teams.select(F.col("team_id").cast("string").alias("team_id")).distinct()
    theirs = players(rows.join(wanted, "team_id", "left_semi"))
    kept = players_by_table(spark, table)
    if kept is None:
        return theirs
    kept = kept.join(wanted, "team_id", "left_semi").select(theirs.columns)
    if whole:
        return theirs if kept.isEmpty() else kept
    return kept.unionByName(theirs.join(kept.select("team_id").distinct(), "team_id", "left_anti"))
