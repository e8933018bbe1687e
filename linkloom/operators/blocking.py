"""Candidate generation: time buckets, and top-k neighbours by hashed trigrams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip_marks


def time_window_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs with equal ``keys`` whose times differ by at most ``seconds``.

    Times are cut into buckets of that length and the left row is looked up in its own bucket and both neighbours, so
    the join is an equi-join on the keys and the bucket, not a nested loop. Column names of both sides must differ but
    for the keys.
    """
    width = max(seconds, 1)
    near = F.explode(F.array(*[(F.floor(F.col(left_time) / width) + i).alias("b") for i in (-1, 0, 1)]))
    a = left.withColumn("_bucket", near)
    b = right.withColumn("_bucket", F.floor(F.col(right_time) / width))
    return a.join(b, [*keys, "_bucket"]).filter(F.abs(F.col(left_time) - F.col(right_time)) <= seconds).drop("_bucket")


def grams(text: Column) -> Column:
    """Trigrams of the kept characters (a-z, 0-9, space); bigrams of a text of two, the text itself if shorter."""
    kept = F.regexp_replace(F.lower(strip_marks(F.coalesce(text, F.lit("")))), "[^a-z0-9 ]", "")

    def cut(c: Column) -> Column:
        n = F.char_length(c)
        size = F.when(n >= 3, 3).otherwise(2)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substr(c, i, size))
        return F.when(n > 0, every).otherwise(F.array().cast("array<string>"))

    return let(kept, cut)


def bucket_of(gram: Column, buckets: int = 256) -> Column:
    """The low byte of the 32-bit FNV-1a hash of a gram of up to three ASCII characters: only that byte takes part."""
    h = F.lit(0xC5)
    for i in (1, 2, 3):
        b = F.ascii(F.substring(gram, i, 1))
        h = F.when(F.char_length(gram) >= i, (h.bitwiseXOR(b) * 0x93).bitwiseAND(0xFF)).otherwise(h)
    return h % buckets


def encode(entities: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, weight): term frequencies of hashed grams, scaled to unit length."""
    rows = entities.select(id_col, F.explode(grams(F.col(text_col))).alias("g")).select(id_col, bucket_of(F.col("g")).alias("bucket"))
    tf = rows.groupBy(id_col, "bucket").agg(F.count("*").cast("double").alias("tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(id_col)))
    return tf.select(id_col, "bucket", (F.col("tf") / norm).alias("weight"))


def dense(encoded: DataFrame, id_col: str, width: int = 256) -> DataFrame:
    """(id, x) of an encoding (id, bucket, weight), with one number for every bucket."""
    held = encoded.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"))
    every = F.sequence(F.lit(0), F.lit(width - 1))
    return held.select(F.col(id_col).alias("id"), F.transform(every, lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0.0))).alias("x"))


#: Queries and entities of one tile of an exact scan, about, and queries that are multiplied at a time.
QUERIES, ENTITIES, AT_ONCE = 2000, 20_000, 128


def _matrix(pdf: pd.DataFrame, width: int) -> np.ndarray:
    """The vectors of rows (_x), or of rows (_x, _at) whose numbers stand at places _at."""
    if "_at" not in pdf:
        return np.stack(pdf["_x"].to_numpy()).astype(np.float64)
    out = np.zeros((len(pdf), width))
    row = np.repeat(np.arange(len(pdf)), pdf["_at"].map(len).to_numpy(dtype=np.int64))
    out[row, np.concatenate(pdf["_at"].to_numpy()).astype(np.int64)] = np.concatenate(pdf["_x"].to_numpy())
    return out


def _nearest(block: list[str], k: int, digits: int, dense_: bool):
    """The k nearest of a tile's entities of each of its queries."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            width = 1 + max(int(np.max(y)) for d in (a, b) for y in d["_at"]) if "_at" in a else 0
            b = b.sort_values("id", kind="stable")
            q, x, ids = _matrix(a, width), _matrix(b, width), b["id"].to_numpy()
            for at in range(0, len(q), AT_ONCE):
                products = q[at : at + AT_ONCE] @ x.T
                for query, raw in zip(a["query_id"].iloc[at : at + AT_ONCE], products, strict=True):
                    kept = np.flatnonzero(ids != query if dense_ else raw > 0)
                    score = np.round(raw[kept], digits)
                    if len(kept) > k:
                        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                        kept, score = kept[near], score[near]
                    best = np.argsort(-score, kind="stable")[:k]
                    out.append(pd.DataFrame({"query_id": query, "id": ids[kept[best]], "score": score[best]}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})
        for i, c in enumerate(block):
            found[c] = key[i]
        return found[[*block, "query_id", "id", "score"]]

    return run


def _scan(queries: DataFrame, entities: DataFrame, block: list[str], k: int, digits: int, dense_: bool) -> DataFrame:
    """(block..., query_id, id, score, rank) from queries (block..., query_id, _x[, _at]) and entities (block..., id, _x[, _at]).

    The queries and the entities of a block are dealt into parts by their hashes. Each pair of parts is a tile, which one task
    holds; it sends on k rows a query, so what is shuffled is vectors and these, never products.
    """
    if not block:
        given = [df.withColumn("_all", F.lit(0)) for df in (queries, entities)]
        return _scan(*given, ["_all"], k, digits, dense_).drop("_all")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides may come from one frame
    queries, entities = fresh(queries), fresh(entities)
    count = lambda df, size, name: df.groupBy(*block).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts = fresh(count(queries, QUERIES, "_qn").join(count(entities, ENTITIES, "_vn"), block))
    part = lambda c, n: F.pmod(F.xxhash64(c, "_x"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(parts, block).withColumn("_qp", part("query_id", "_qn")).withColumn("_vp", every("_vn")).drop("_qn", "_vn")
    v = entities.join(fresh(parts), block).withColumn("_vp", part("id", "_vn")).withColumn("_qp", every("_qn")).drop("_qn", "_vn")
    q, v = fresh(q), fresh(v)
    kinds = dict(queries.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*block, "query_id"]], f"id {dict(entities.dtypes)['id']}", "score double"])
    tile = [*block, "_qp", "_vp"]
    near = q.groupBy(*tile).cogroup(v.groupBy(*tile)).applyInPandas(_nearest(block, k, digits, dense_), schema)
    w = Window.partitionBy(*block, "query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, entities: DataFrame, block: list[str], k: int = 10, digits: int = 12) -> DataFrame:
    """The k nearest entities of each query inside its block, by cosine of the sparse encodings; exact.

    ``queries`` has (block..., query_id, bucket, weight) and ``entities`` (block..., id, bucket, weight). Only pairs that share a
    bucket count. Scores are rounded to ``digits``, so that equal encodings tie; ties go to the smaller id.
    """
    held = lambda df, c: df.groupBy(*block, c).agg(F.collect_list("bucket").alias("_at"), F.collect_list(F.col("weight").cast("double")).alias("_x"))  # noqa: E731  a row a bucket
    return _scan(held(queries, "query_id"), held(entities, "id"), block, k, digits, False)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 5, block: tuple[str, ...] = ()) -> DataFrame:
    """(block..., query_id, id, score, rank): the k nearest of all ``vectors`` of each query but itself, by rounded cosine; exact.

    Both have (id, x), and the columns of ``block`` if only vectors that are equal in these are to meet. Vectors of
    different lengths do not meet, those without a direction are left out. Ties go to the smaller id.
    """

    def unit(df: DataFrame, name: str) -> DataFrame:
        x = F.transform("x", lambda v: v.cast("double"))
        sized = df.select(*block, F.col("id").alias(name), x.alias("_x")).withColumn("_n", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)))
        return sized.filter("_n > 0").select(*block, name, F.size("_x").alias("_width"), F.transform("_x", lambda v: v / F.col("_n")).alias("_x"))

    return _scan(unit(queries, "query_id"), unit(vectors, "id"), [*block, "_width"], k, digits, True).drop("_width")


def event_text(home: Column, away: Column) -> Column:
    return F.concat_ws(" vs ", home, away)
