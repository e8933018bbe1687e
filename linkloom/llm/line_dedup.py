"""Cross-site boilerplate lines by distinct-site spread.

A line (white space around it stripped, with at least one word) is boilerplate when it stands on ``MIN_SITES`` or more
distinct sites. Its spread is estimated by a HyperLogLog sketch of the sites of its raw rows, built where the rows are
and merged by aggregation; only where the estimate is too near the threshold to decide, the sites are counted exactly.
A boilerplate line stays where it stands first (smallest doc_id, then position) and goes everywhere else.

Defined results: a null text stays null and has no lines; a null site is no site; blank lines are never removed;
an empty table gives an empty result; rows that repeat id and text get the same result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, join_hot, let, settled, stored, whole_row, with_key

MIN_SITES = 12
LG_K = 12
#: Half-width of the undecided band in standard errors of the sketch (1.04 / sqrt(2**LG_K)).
BAND = 4.0


def line_rows(docs: DataFrame) -> DataFrame:
    """(_id, _tie, site, pos, line hash) of each line that has a word."""
    return (
        with_key(docs, F.col("source").cast("string").alias("site"))
        .select("_id", "_tie", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .filter(F.col("line").rlike(WORD))
        .select("_id", "_tie", "site", "pos", F.xxhash64(F.trim("line", F.lit(SPACES))).alias("lh"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(lh, n, first) of each line hash of the stored table ``lines`` on ``min_sites`` or more distinct sites: its rows
    and where it stands first.

    A line that occurs fewer than ``min_sites`` times cannot be on so many sites; only the others get a sketch.
    """
    sited = F.count("site").alias("sited")
    often = lines.groupBy("lh").agg(F.count("*").alias("n"), sited, F.min(F.struct("_id", "_tie", "pos")).alias("first")).filter(F.col("sited") >= min_sites)
    often = stored(often, "often")
    total = often.agg(F.sum("n")).first()[0] or 0
    raw = join_hot(lines.filter(F.col("site").isNotNull()), often.select("lh", "n"), "lh", "n", total).select("lh", "site")
    spread = stored(raw.groupBy("lh").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n_sites")), "spread")
    half = max(1.0, BAND * 1.04 / (2**LG_K) ** 0.5 * min_sites)
    sure = spread.filter(F.col("n_sites") > min_sites + half).select("lh")
    near = spread.filter(F.abs(F.col("n_sites") - min_sites) <= half).select("lh").join(often.select("lh", "n"), "lh")
    pairs = join_hot(lines.filter(F.col("site").isNotNull()), stored(near, "near"), "lh", "n", total).select("lh", "site").distinct()
    exact = pairs.groupBy("lh").count().filter(F.col("count") >= min_sites).select("lh")
    return often.join(sure.unionByName(exact), "lh", "left_semi").select("lh", "n", "first")


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(_id, _tie, _drop): the places of the boilerplate lines of each document that has any, but where a line stands first."""
    lines = stored(line_rows(docs), "lines")
    known = stored(boilerplate(lines, min_sites), "boilerplate")
    found = join_hot(lines, known, "lh", "n", known.agg(F.sum("n")).first()[0] or 0).filter(F.struct("_id", "_tie", "pos") != F.col("first"))
    return found.groupBy("_id", "_tie").agg(F.collect_list("pos").alias("_drop"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(_row, text, n_lines, n_removed): each row of ``docs``, its text without boilerplate, its lines and how many went."""
    drop = settled(lambda: removed_lines(docs, min_sites), "removed")
    rows = with_key(docs, whole_row(docs).alias("_row")).drop("text").join(drop, ["_id", "_tie"], "left")
    parts = F.split(F.col("_row.text"), "\n", -1)
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_drop"), lambda i: F.get(x, i))
    kept = F.array_join(let(parts, stay), "\n")
    return rows.select(
        "_row",
        F.when(F.col("_drop").isNull(), F.col("_row.text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_removed"),
    )


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without boilerplate, and new columns ``n_lines`` and ``n_removed``.

    Where ``docs`` has a column of such a name its own stays, and the new one is named with an underscore before it.
    """
    names = {c: c if c not in docs.columns else f"_{c}" for c in ("n_lines", "n_removed")}
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "text"]
    return cleaned(docs, min_sites).select(*own, "text", *[F.col(c).alias(n) for c, n in names.items()])
