"""A stream of source events in batches gives what one run gives."""

import random

import pytest

from linkloom import streaming
from linkloom.operators import events

from .test_segments import EVENT, T0, games

DAY = 86400


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size", [2000, 12])
def test_batches_are_one_run(spark, tmp_path, size):
    rng = random.Random(7)
    source = sorted(games(rng, 60, "s", 30, other_names=True), key=lambda r: (r[2] or 0, r[1]))
    target = spark.createDataFrame(games(rng, 60, "t", 30), EVENT)
    cuts = [next(i for i in range(k, 60) if (source[i][2] or 0) // 3600 != (source[i - 1][2] or 0) // 3600) for k in (20, 40)]
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60], strict=True)):
        spark.createDataFrame(source[a:b], EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        streaming.match_batch(spark.read.schema(EVENT).parquet(str(tmp_path / "in" / f"{n}")), n, target, str(tmp_path / "batches"), size)
    got = rows(streaming.stream_matches(spark, str(tmp_path / "batches")))
    assert got == rows(events.match_events(spark.createDataFrame(source, EVENT), target))
    # a batch that is repeated changes nothing
    streaming.match_batch(spark.read.schema(EVENT).parquet(str(tmp_path / "in" / "1")), 1, target, str(tmp_path / "batches"), size)
    assert rows(streaming.stream_matches(spark, str(tmp_path / "batches"))) == got


def test_a_target_is_taken_once(spark, tmp_path):
    target = spark.createDataFrame([("L", "t1", T0, "x", "Arsenal", "y", "Chelsea")], EVENT)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("L", "s1", T0, "a", "Arsenal", "c", "Chelsea")], EVENT).coalesce(1).write.parquet(str(folder))
    for n in range(2):
        stream = spark.readStream.schema(EVENT).parquet(str(folder))
        streaming.match_stream(stream, lambda: target, out, str(tmp_path / "state")).awaitTermination()
        spark.createDataFrame([("L", f"s{n + 2}", T0 + 60, "a", "Arsenal", "c", "Chelsea")], EVENT).coalesce(1).write.mode("append").parquet(str(folder))
    got = {r["event_id"]: r["target_id"] for r in streaming.stream_matches(spark, out).collect()}
    assert got == {"s1": "t1", "s2": ""}
