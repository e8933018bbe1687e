"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, release, stored


def _summary(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that it is connected to.

    Large-star and small-star steps in turn: every step keeps at most as many edges and hangs nodes on smaller ones,
    until each node hangs on the smallest of its component. A step is two aggregations by node with map-side combine and
    a join in which hubs are salted; its result is written, so a lost executor costs one step at most.
    """
    now = stored(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before, seen = None, _summary(now)
    while seen != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = join_salted(both, least, "a", "n", 2 * seen[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        moved = join_salted(large, low, "a", "n", 2 * seen[0]).filter("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = stored(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        release(now, least, large, low)
        now, before, seen = after, seen, _summary(after)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
