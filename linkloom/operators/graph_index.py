"""Approximate nearest neighbours by navigable graphs (N2): an index in parts, built on all rows, searched in bounded hops.

Rows are dealt into parts of about ``PART`` by a hash of their ids. In each part every vector is linked to its ``LINKS``
nearest ones, to those that have it among theirs, and to a few at random, so that no group of like vectors is cut off. A
search goes from a few entries along the links, block of queries by block, and keeps the ``beam`` best so far; it ends
when none of them is left to be followed, or after ``HOPS`` steps. The best of all parts are merged. A part is one row of
the index table, as large however many rows there are, and a lost task repeats one part or one block.

Where a plain scan of all vectors is affordable, :func:`.blocking.dense_top_k` gives the exact result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

PART = 20_000
LINKS, STRAY = 16, 4
HOPS = 200
ENTRIES = 8
#: Queries that are followed at once.
BLOCK = 256
INDEX = "part int, width int, ids array<bigint>, x binary, links binary, degree int"


def unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at unit length, and which of them have a length."""
    x = np.stack(rows).astype(np.float32)
    n = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    ok = n > 0
    return (x[ok] / n[ok, None]).astype(np.float32), ok


def links_of(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Row i: the places that vector i is linked to, filled up with i itself."""
    n, m = len(x), min(LINKS, max(len(x) - 1, 0))
    near = np.zeros((n, m), dtype=np.int64)
    for begin in range(0, n if m else 0, 1024):
        s = x[begin : begin + 1024] @ x.T
        s[np.arange(len(s)), np.arange(begin, begin + len(s))] = -np.inf
        near[begin : begin + len(s)] = np.argpartition(-s, m - 1, axis=1)[:, :m]
    stray = np.random.default_rng(seed).integers(0, n, (n, STRAY))
    own = np.arange(n)
    # strays always stay, then a vector's own links, then those of others
    a = np.concatenate((np.repeat(own, STRAY), np.repeat(own, m), near.ravel()))
    b = np.concatenate((stray.ravel(), near.ravel(), np.repeat(own, m)))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    width = STRAY + 3 * LINKS
    out = np.repeat(own[:, None], width, axis=1)
    fits = place < width
    out[a[fits], place[fits]] = b[fits]
    return out.astype(np.int32)


def follow(q: np.ndarray, x: np.ndarray, links: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of about the ``k`` nearest vectors of each query, best first."""
    rows = np.arange(len(q))[:, None]
    start = np.unique(np.linspace(0, len(x) - 1, ENTRIES).astype(np.int64))
    seen = np.zeros((len(q), len(x)), dtype=bool)
    seen[:, start] = True
    places = np.repeat(start[None, :], len(q), axis=0)
    scores = q @ x[start].T
    done = np.zeros(places.shape, dtype=bool)
    for _ in range(HOPS):
        open_ = np.where(done, -np.inf, scores)
        best = open_.argmax(axis=1)[:, None]
        if not np.isfinite(open_[rows, best]).any():
            break
        live = np.isfinite(open_[rows, best])
        done[rows, best] = True
        more = links[places[rows, best][:, 0]].astype(np.int64)
        # a link that stands twice in a row counts once
        order = np.sort(more, axis=1)
        new = ~seen[rows, order] & live
        new[:, 1:] &= order[:, 1:] != order[:, :-1]
        s = np.where(new, np.einsum("qd,qmd->qm", q, x[order]), -np.inf)
        seen[np.broadcast_to(rows, order.shape)[new], order[new]] = True
        places, scores = np.concatenate((places, order), axis=1), np.concatenate((scores, s), axis=1)
        done = np.concatenate((done, ~new), axis=1)
        if scores.shape[1] > beam:
            top = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
            places, scores, done = places[rows, top], scores[rows, top], done[rows, top]
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return places[rows, order], scores[rows, order]


def build(vectors: DataFrame, part: int = PART) -> DataFrame:
    """The index (INDEX) of ``vectors`` (id, x); those without a length are left out. Write it to keep it."""
    vectors = vectors.filter("size(x) > 0").select(F.col("id").cast("long").alias("id"), "x")
    parts = max(1, math.ceil(vectors.count() / part))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, same in pdf.groupby(pdf["x"].map(len)):
            x, ok = unit(same["x"].tolist())
            if len(x):
                links = links_of(x, int(pdf["part"].iloc[0]))
                out.append((int(pdf["part"].iloc[0]), int(width), same["id"].to_numpy()[ok], x.tobytes(), links.tobytes(), links.shape[1]))
        return pd.DataFrame(out, columns=["part", "width", "ids", "x", "links", "degree"])

    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(run, INDEX)


def search(queries: DataFrame, index: DataFrame, k: int, beam: int = 192, digits: int = 5) -> DataFrame:
    """(query_id, id, score, rank): about the k nearest of the index's vectors of each query (id, x) but itself."""
    queries = queries.filter("size(x) > 0").select(F.col("id").cast("long").alias("query_id"), F.col("x").alias("q"))
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    parts = index.select("part").distinct()
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    packed = cut(asked.groupBy("block").agg(F.collect_list(F.struct("query_id", "q")).alias("asked")))  # about BLOCK queries
    met = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block").join(index, "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                same = [a for a in r.asked if len(a["q"]) == r.width]
                if not same:
                    continue
                q, ok = unit([a["q"] for a in same])
                asked_ids, ids = np.array([a["query_id"] for a in same])[ok], np.asarray(r.ids)
                x, links = np.frombuffer(r.x, dtype=np.float32).reshape(-1, r.width), np.frombuffer(r.links, dtype=np.int32).reshape(-1, r.degree)
                if not len(q):
                    continue
                places, scores = follow(q, x, links, k + 1, max(beam, k + 1))
                found = pd.DataFrame({"query_id": np.repeat(asked_ids, places.shape[1]), "id": ids[places.ravel()], "score": scores.ravel().astype(np.float64)})
                yield found[np.isfinite(found["score"]) & (found["query_id"] != found["id"])]

    near = met.select("asked", "width", "ids", "x", "links", "degree").mapInPandas(run, "query_id bigint, id bigint, score double")
    near = near.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
