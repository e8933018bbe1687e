"""Matching of source events as they arrive.

Each micro-batch is matched in order against the targets that no earlier batch has taken, with the aliases that earlier
batches taught, so batches that come in order give what one run over all of them gives. The state is what earlier batches
wrote: a batch that is repeated after a failure reads the batches before its own number and writes the same again. Target
events are read anew for each batch, so that a late target is seen by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import match_rows, matches_of
from ..operators.segments import OUT, SEGMENT


def _before(batch: DataFrame, path: str, number: int) -> DataFrame | None:
    """What batches before this one have written about its leagues."""
    if number == 0:
        return None
    spark = batch.sparkSession
    rows = spark.read.schema(f"{OUT}, batch bigint").option("basePath", path).parquet(path).filter(F.col("batch") < number)
    return rows.join(batch.select("league_id").distinct(), "league_id", "left_semi")


def match_batch(batch: DataFrame, number: int, target: DataFrame, path: str, size: int = SEGMENT) -> None:
    """Match one micro-batch and keep what it took and taught under its number."""
    match_rows(batch, target, size=size, before=_before(batch, path, number)).write.mode("overwrite").parquet(f"{path}/batch={number}")


def match_stream(source: DataFrame, target: Callable[[], DataFrame], path: str, checkpoint: str, size: int = SEGMENT) -> StreamingQuery:
    """Match each micro-batch of ``source`` (canonical events with league_id and event_id) into the table at ``path``."""

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            match_batch(batch, number, target(), path, size)
        finally:
            batch.unpersist()

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_matches(spark, path: str) -> DataFrame:
    """All matches that a stream has made so far."""
    return matches_of(spark.read.schema(f"{OUT}, batch bigint").option("basePath", path).parquet(path))
