"""Divergence audit of sources: how far the term shares of each source are from those of every other source of its language.

Terms are runs of ASCII letters (lower-cased) and of characters beyond ASCII; a language keeps the V terms that at least
``MIN_DOCS`` of its documents hold. A group is a (lang, source). It gives a term that it has c times, of N kept terms
in all, the share ``p = 1 + floor(SCALE * (c + 1) / (N + V))``; q is the other side's share and
``f = floor((p - q) ** 2 / q)``. All of it is whole numbers, exact for counts up to 2 ** 48.

1. Tasks count the terms of their documents by group and deal the counts into blocks by a hash of the term: a row is one
   group's packed counts in one block. Rows of one group and block are merged, then the groups of one (lang, block).
   Blocks are the vocabulary chunks; there are as many as the text has ``CHUNK_BYTES``, so that a chunk stays as it is
   while the corpus grows. Common terms and large sources are split by chunks and merged before they meet.
2. The groups of a language are dealt into blocks of about ``BLOCK``. A pair of group blocks is a tile; the packed
   vectors of both are replicated to it, and its task goes through the vocabulary chunks one after the other, adding up
   the submatrix of its pairs. A long vocabulary is cut into segments of ``SEGMENT`` chunks, whose submatrices are added
   up. Terms that neither side of a tile has cost one multiplication.
3. The terms that set a group apart from its language are ranked inside each chunk, then over the chunks' best.

Defined results: a null text, lang or source is empty; a null id is a document like any other; rows that repeat count one
by one; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Bytes of text for each vocabulary chunk.
CHUNK_BYTES = 16 << 20
#: Groups of a group block, about, and chunks of a segment.
BLOCK = 16
SEGMENT = 8
#: Counts that a task holds at most before it passes them on.
HELD = 400_000

#: What each byte of a text counts as: A-Z lower-cased, other ASCII but letters a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, chunk long, terms string, c binary, df binary"
VECTORS = "lang string, chunk long, source string, size long, n long, at binary, c binary, terms string"


def narrow(a: np.ndarray) -> bytes:
    """Whole numbers that are not negative, in the fewest bytes each; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def shares(c: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (c + 1) / total), in two steps that stay inside 64 bits."""
    high, rest = np.divmod((c + 1) * 31_250, total)
    return 1 + high * 32_000 + rest * 32_000 // total


def _rows(held: dict, chunks: int) -> Iterator[tuple]:
    """One row for each group and chunk of the counts that a task holds."""
    for (lang, source), (count, docs) in held.items():
        terms = np.array(list(count), dtype=object)
        c = np.fromiter(count.values(), dtype=np.int64, count=len(terms))
        df = np.fromiter(map(docs.__getitem__, terms), dtype=np.int64, count=len(terms))
        chunk = np.fromiter(map(zlib.crc32, terms), dtype=np.int64, count=len(terms)) % chunks
        order = np.argsort(chunk, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(chunk[order])) + 1, len(order))
        begin = 0
        for end in ends.tolist() if len(order) else []:
            part = order[begin:end]
            yield lang, source, int(chunk[part[0]]), b" ".join(terms[part].tolist()).decode(), narrow(c[part]), narrow(df[part])
            begin = end


def count_terms(docs: DataFrame, chunks: int) -> DataFrame:
    """What each task counts: rows (COUNTED) of a group and a chunk, c occurrences in df documents of each term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in COUNTED.split(", ")]
        held, size = {}, 0
        for pdf in batches:
            for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
                count, of_docs = held.setdefault((lang, source), (Counter(), Counter()))
                words = text.encode("utf-8").translate(_TERMS).split()
                size -= len(count)
                count.update(words)
                of_docs.update(set(words))
                size += len(count)
                if size > HELD:
                    yield pd.DataFrame(list(_rows(held, chunks)), columns=names)
                    held, size = {}, 0
        yield pd.DataFrame(list(_rows(held, chunks)), columns=names)

    return docs.mapInPandas(run, COUNTED)


def _joined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all rows one after the other, how many each row has)."""
    lists = [t.split(" ") if t else [] for t in pdf["terms"]]
    return np.array([t for x in lists for t in x], dtype=object), np.array([len(x) for x in lists], dtype=np.int64)


def merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one group and chunk as one row."""
    if len(pdf) == 1:
        return pdf
    terms, _ = _joined(pdf)
    code, distinct = pd.factorize(terms)
    sums = []
    for name in ("c", "df"):
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, code, np.concatenate([widen(x) for x in pdf[name]]))
        sums.append(narrow(total))
    first = pdf.iloc[0]
    return pd.DataFrame([(first["lang"], first["source"], first["chunk"], " ".join(distinct.tolist()), *sums)], columns=pdf.columns)


def chunk_vectors(pdf: pd.DataFrame, least: int = MIN_DOCS) -> pd.DataFrame:
    """The kept terms of a (lang, chunk): one row with the terms and the language's counts (source null), one a group."""
    terms, sizes = _joined(pdf)
    code, distinct = pd.factorize(terms)
    c, df = (np.concatenate([widen(x) for x in pdf[name]] or [np.zeros(0, dtype=np.int64)]) for name in ("c", "df"))
    docs = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(docs, code, df)
    kept = np.flatnonzero(docs >= least)
    place = np.full(len(distinct), -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    at = place[code]
    total = np.zeros(len(kept), dtype=np.int64)
    np.add.at(total, at[at >= 0], c[at >= 0])
    lang, chunk, size = pdf["lang"].iloc[0], pdf["chunk"].iloc[0], len(kept)
    out = [(lang, chunk, None, size, int(total.sum()), None, narrow(total), " ".join(distinct[kept].tolist()))]
    for source, end, many in zip(pdf["source"], np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        mine, own = at[end - many : end], c[end - many : end]
        mine, own = mine[mine >= 0], own[mine >= 0]
        if len(mine):
            by = np.argsort(mine)
            out.append((lang, chunk, source, size, int(own.sum()), narrow(mine[by]), narrow(own[by]), None))
    return pd.DataFrame(out, columns=[x.split()[0] for x in VECTORS.split(", ")])


def packed_vectors(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """Rows (VECTORS) of every (lang, chunk) and of every group that has kept terms in it."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = count_terms(docs, max(1, math.ceil(size / CHUNK_BYTES)))
    merged = counted.groupBy("lang", "source", "chunk").applyInPandas(merge_group, COUNTED)
    return merged.groupBy("lang", "chunk").applyInPandas(lambda pdf: chunk_vectors(pdf, least), VECTORS)


def _submatrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q) ** 2 / q) for each row of p with each row of q."""
    out = np.zeros((len(p), len(q)), dtype=np.int64)
    for i, row in enumerate(p):
        gap = row - q
        out[i] = (gap * gap // q).sum(axis=1)
    return out


def tile_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The submatrix of each tile and segment, from its rows in order: first its members, then chunk after chunk.

    Rows have tile (lang, low, high, segment), chunk (-1: a member), source, block, size, n, v, at and c. A pair comes out
    with the sum over the terms of the chunks that were there, their number, and what a term that neither has adds.
    """
    names = ["lang", "a", "b", "value", "seen", "neither", "v"]
    tile, chunk, vectors, sides, seen = None, None, [], None, 0

    def add() -> None:
        nonlocal seen
        if not vectors:
            return
        size = vectors[0][1]
        mats = []
        for index, total, sums in sides[:2]:
            m = np.tile(shares(np.zeros(1, dtype=np.int64), total[:, None]), (1, size))
            for source, _, at, c in vectors:
                if source in index:
                    i = index[source]
                    m[i, widen(at)] = shares(widen(c), total[i])
            mats.append(m)
        sides[2][:] += _submatrix(mats[0], mats[1])
        if tile[1] != tile[2]:
            sides[3][:] += _submatrix(mats[1], mats[0])
        seen += size

    def finished() -> pd.DataFrame:
        (left, lt, _), (right, rt, _) = sides[:2]
        zero = lambda total: shares(np.zeros(1, dtype=np.int64), total[:, None])
        out = []
        for (rows, row_total), (cols, col_total), sums in (((left, lt), (right, rt), sides[2]), ((right, rt), (left, lt), sides[3]))[: 1 + (tile[1] != tile[2])]:
            neither = _submatrix(zero(row_total), zero(col_total))
            for a, i in rows.items():
                out += [(tile[0], a, b, int(sums[i, j]), seen, int(neither[i, j]), sides[4]) for b, j in cols.items() if a != b]
        return pd.DataFrame(out, columns=names)

    members: list = []

    def opened() -> None:
        nonlocal sides
        if sides is None:
            found = []
            for block in (tile[1], tile[2]):
                own = sorted((s, n + v) for s, k, n, v in members if k == block)
                found.append(({s: i for i, (s, _) in enumerate(own)}, np.maximum(np.array([t for _, t in own], dtype=np.int64), 1), None))
            shape = (len(found[0][0]), len(found[1][0]))
            sides = (*found, np.zeros(shape, dtype=np.int64), np.zeros(shape[::-1], dtype=np.int64), members[0][3])

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            mine = (r.lang, r.low, r.high, r.segment)
            if mine != tile:
                if tile is not None:
                    opened()
                    add()
                    yield finished()
                tile, chunk, vectors, sides, seen, members = mine, None, [], None, 0, []
            if r.chunk < 0:
                members.append((r.source, r.block, r.n, r.v))
                continue
            opened()
            if r.chunk != chunk:
                add()
                chunk, vectors = r.chunk, []
            vectors.append((r.source, r.size, r.at, r.c))
    if tile is not None:
        opened()
        add()
        yield finished()


def pair_values(vectors: DataFrame, groups: DataFrame, segments: int) -> DataFrame:
    """(lang, a, b, value) of every ordered pair of groups of a language. ``groups`` has lang, source, n, v and blocks."""
    block = F.pmod(F.xxhash64(F.col("source")), F.col("blocks"))
    named = groups.withColumn("block", block)
    empty = lambda kind: F.lit(None).cast(kind)
    members = named.select("lang", "source", "block", "blocks", "n", "v", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("size"), empty("binary").alias("at"), empty("binary").alias("c"))  # noqa: E501
    own = vectors.filter("source is not null").drop("n", "terms").join(named, ["lang", "source"])
    own = own.withColumn("segment", F.pmod("chunk", F.lit(segments)).cast("int"))
    rows = own.select(members.columns).unionByName(members).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    order = ["lang", "low", "high", "segment"]
    dealt = rows.repartition(*[F.col(x) for x in order]).sortWithinPartitions(*order, "chunk", "source")
    sums = dealt.mapInPandas(tile_sums, "lang string, a string, b string, value long, seen long, neither long, v long")
    added = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("neither").alias("neither"), F.first("v").alias("v"))
    return added.select("lang", "a", "b", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("neither")).alias("value"))


def distinctive_terms(vectors: DataFrame, groups: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """(lang, source, term, value) of the ``most`` terms of each group, in each chunk, that it has above its language's share."""
    own = vectors.filter("source is not null").drop("n", "terms").join(groups.select("lang", "source", "n", "v", "lang_n"), ["lang", "source"])
    # the language's row of a chunk carries no group; it is told by its terms
    head = vectors.filter("source is null").withColumn("v", F.lit(0).cast("long")).withColumn("lang_n", F.lit(0).cast("long"))
    columns = ["lang", "chunk", "source", "n", "v", "lang_n", "at", "c", "terms"]
    rows = own.withColumn("terms", F.lit(None).cast("string")).select(columns).unionByName(head.select(columns))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["source"].notna()
        head = pdf[~known].iloc[0]
        terms, total = np.array(head["terms"].split(" "), dtype=object), widen(head["c"])
        order = np.empty(len(terms), dtype=np.int64)
        order[np.argsort([t.encode() for t in terms])] = np.arange(len(terms))
        out = []
        for r in pdf[known].itertuples(index=False):
            at = widen(r.at)
            p, q = shares(widen(r.c), r.n + r.v), shares(total[at], r.lang_n + r.v)
            more = p > q
            at, f = at[more], (p[more] - q[more]) ** 2 // q[more]
            best = np.lexsort((order[at], -f))[:most]
            out += [(r.lang, r.source, t, v) for t, v in zip(terms[at[best]].tolist(), f[best].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["lang", "source", "term", "value"])

    return rows.groupBy("lang", "chunk").applyInPandas(run, "lang string, source string, term string, value long")


def _ranked(rows: DataFrame, part: str, item: Column) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), item.alias("item"), "value").withColumn("rank", F.row_number().over(w))


def audit(docs: DataFrame, least: int = MIN_DOCS, most: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by their divergence,
    part ``term`` the group's ``most`` terms that set it apart from its language."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    vectors = stored(packed_vectors(docs, least), "vectors")
    held = vectors.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("size").alias("v"), F.countDistinct("chunk").alias("chunks"))
    held = stored(held, "held")
    langs = held.filter("source is null").select("lang", "v", F.col("n").alias("lang_n"))
    occurring = docs.select("lang", "source").distinct()
    blocks = occurring.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    groups = occurring.join(held.filter("source is not null").select("lang", "source", "n"), ["lang", "source"], "left").join(langs, "lang", "left").join(blocks, "lang")
    groups = stored(groups.fillna(0, ["n", "v", "lang_n"]), "groups")
    segments = math.ceil((held.agg(F.max("chunks")).first()[0] or 1) / SEGMENT)
    release(held)
    pairs = pair_values(vectors, groups, segments)
    terms = distinctive_terms(vectors, groups, most)
    ranked = _ranked(pairs.withColumnRenamed("a", "source"), "pair", F.col("b"))
    return ranked.unionByName(_ranked(terms, "term", F.col("term")).filter(F.col("rank") <= most))
