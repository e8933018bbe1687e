"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. The number of pieces of each length (at most ``capacity``
numbers, whatever the corpus) is packed on the driver: the longest length left opens a sequence; a hash index from sums
to the pairs of lengths that have them, kept as lengths run out, gives a single, a pair or a triple (a length and a pair)
that fills the gap exactly, and as many sequences of that kind are taken as the counts allow; where no combination fits
exactly, the longest length that fits goes in (best fit) and the search goes on with the smaller gap. Each pattern uses up a length, so there are no more patterns than lengths to speak
of. Pieces then find their place by their rank among the pieces of their length, counted in sub-buckets so that a
length that very many documents share is spread over many tasks.

Defined results: a null or empty text is the end id alone; null ids and repeated rows are packed like any other row; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, slices
from .common import group_ranks, stored, table_of

CAPACITY = 4096
END_ID = 1


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids followed by ``end_id``."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = codec(tokenizer)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            at = pdf["doc_id"].astype("Int64")
            for part in slices(texts):
                rows = []
                for doc, ids in zip(at.iloc[part], words.encode(texts[part]), strict=True):
                    ids += end
                    for start in range(0, len(ids) // 4, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, start // capacity, start, len(piece) // 4, zlib.crc32(piece)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Index:
    """Counts of the lengths left, and an index from sums to the combinations of up to three of them.

    ``pairs[total]`` lists the smaller parts of the pairs that had that sum when it was first asked for, most plentiful
    last; counts only fall, so a pair that has run out is taken off the end for good. A triple is a length and an
    indexed pair; ``tried[total]`` remembers the smallest length that was tried as the first of three in vain.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        self.pairs: dict[int, list[int]] = {}
        self.tried: dict[int, int] = {}
        for length, n in counts.items():
            self.left[length] = n

    def longest(self, most: int) -> int:
        found = np.flatnonzero(self.left[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def single(self, gap: int) -> list[int]:
        return [gap] if self.left[gap] > 0 else []

    def _indexed(self, gap: int) -> list[int]:
        if gap not in self.pairs:
            both = np.minimum(self.left[1 : gap // 2 + 1], self.left[gap - 1 : gap - gap // 2 - 1 : -1])
            found = np.flatnonzero(both)
            self.pairs[gap] = (found[np.argsort(both[found], kind="stable")] + 1).tolist()
        return self.pairs[gap]

    def pair(self, gap: int) -> list[int]:
        parts = self._indexed(gap)
        while parts:
            x = parts[-1]
            if self.left[x] > (x + x == gap) and self.left[gap - x] > 0:
                return [gap - x, x]
            parts.pop()
        return []

    def triple(self, gap: int) -> list[int]:
        most = min(self.tried.get(gap, gap), gap - 1)
        for x in (np.flatnonzero(self.left[1:most]) + 1)[::-1].tolist():
            rest = self._indexed(gap - x)
            for low in reversed(rest):
                three = Counter((x, low, gap - x - low))
                if all(self.left[y] >= n for y, n in three.items()):
                    return [x, gap - x - low, low]
            self.tried[gap] = x
        return []

    def exact(self, gap: int, top: int) -> list[int]:
        """A combination that sums up to ``gap``; ``top`` is the longest length left."""
        if gap > 3 * top:
            return []
        return (gap <= top and self.single(gap)) or (gap <= 2 * top and self.pair(gap)) or self.triple(gap)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences), covering all ``counts``."""
    index, out = _Index(counts, capacity), []
    while length := index.longest(capacity):
        pattern, gap = [length], capacity - length
        index.left[length] -= 1
        while gap:
            top = index.longest(min(gap, length))
            more = index.exact(gap, top) or ([top] if top else [])
            if not more:
                break
            pattern += more
            gap -= sum(more)
            for x in more:
                index.left[x] -= 1
        used = Counter(pattern)
        times = 1 + min(int(index.left[x]) // n for x, n in used.items())
        for x, n in used.items():
            index.left[x] -= n * (times - 1)
        out.append((pattern, times))
    return out


def places(found: list[tuple[list[int], int]]) -> list[list[int]]:
    """Rows [length, first rank, end rank, first sequence, offset, pieces a sequence] of the patterns."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in found:
        offset = 0
        for length, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append([length, rank[length], rank[length] + n * times, sequence, offset, n])
            rank[length] += n * times
            offset += n * length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = places(patterns(counts, capacity))
    spans = table_of(spark, rows, "a_length long, a_from long, a_to long, a_sequence long, a_offset long, a_n long")
    ranked = group_ranks(pieces, "length", ["doc_id", "piece", "ids_crc32"], sum(counts.values()))
    inside = F.col("rank") - F.col("a_from")
    # the spans number at most the patterns times the different lengths in one, both bounded by the capacity
    joined = ranked.join(F.broadcast(spans), (F.col("length") == F.col("a_length")) & (F.col("rank") >= F.col("a_from")) & (F.col("rank") < F.col("a_to")))
    return joined.select(
        *pieces.columns,
        (F.col("a_sequence") + F.floor(inside / F.col("a_n"))).alias("sequence_id"),
        (F.col("a_offset") + inside % F.col("a_n") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces_of(docs, tokenizer, capacity, end_id), capacity)
