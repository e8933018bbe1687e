"""Detection of periodic runs of words, and their collapse to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and of at least
``max(MIN_WORDS, 2 * q)`` words that no neighbouring word extends keeping the period.

For each period p a text has grid points 0, p, 2p, ...; over all periods they are as many as n times a harmonic number.
A run of period p is at least two periods long, so it holds two neighbouring grid points, which then carry the same
word. From these pairs the common extensions to both sides are found by binary search over prefix hashes, for all pairs
(period, grid point) of many texts at once. Words are numbers that are exact inside a task, so what the hashes claim is
verified word by word; a hash never takes equal words for different ones, and a claim that fails is measured again word
by word. One run is found from several grid points and under multiples of its period: of equal stretches the smallest
period stays.

Every text is whole inside one row and no row meets another, so there is no shuffle. Texts are taken in groups of about
``WORDS_AT_ONCE`` words and pairs in slices of ``PAIRS_AT_ONCE``, which bounds the memory beside the longest text.

Defined results: a null or empty text has no words and no run; a null id is kept as it is; rows that repeat are taken
one by one; an empty table gives an empty result. All columns of the input go through in one struct, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import whole_row
from .shingles import mix

MIN_WORDS = 12
WORDS_AT_ONCE = 200_000
PAIRS_AT_ONCE = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)

FOUND = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def grid(bounds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(grid point, period) of the periods ``low`` to ``high - 1`` of each text; both the point and the next lie in the text."""
    n = np.diff(bounds)
    most = np.minimum(n // 2, high - 1)
    text = np.repeat(np.arange(len(n)), np.maximum(most - low + 1, 0))
    first = np.cumsum(np.maximum(most - low + 1, 0)) - np.maximum(most - low + 1, 0)
    period = np.arange(len(text)) - first[text] + low
    points = (n[text] - 1) // period  # the last point has none after it
    at = np.repeat(np.cumsum(points) - points, points)
    owner = np.repeat(np.arange(len(text)), points)
    return bounds[:-1][text[owner]] + (np.arange(len(owner)) - at) * period[owner], period[owner]


def _slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of periods that have about PAIRS_AT_ONCE grid points together, a single period at least."""
    n = np.diff(bounds)
    longest = int(n.max(initial=0)) // 2
    low = 1
    while low <= longest:
        # texts shorter than two periods have no points; the others at most n / low a period
        live = int(n[n >= 2 * low].sum())
        high = low + max(1, PAIRS_AT_ONCE * low // max(live, 1))
        yield low, min(high, longest + 1)
        low = high


def _sums(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes of the words and the powers of their base, modulo 2 ** 64."""
    powers = np.full(len(ids) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(mix(ids.astype(np.uint64), 5) * powers[:-1], out=sums[1:])
    return sums, powers


def extensions(sums: np.ndarray, powers: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from x and y on (``step`` 1) or before them (-1) agree by their hashes, up to ``most``."""
    low, high = np.zeros(len(x), dtype=np.int64), most.astype(np.int64)
    shift = powers[y - x]
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        a, b = (x, x + mid) if step > 0 else (x - mid, x)
        c, d = (y, y + mid) if step > 0 else (y - mid, y)
        same = (sums[b] - sums[a]) * shift == sums[d] - sums[c]
        low = np.where(same, mid, low)
        high = np.where(same, high, np.maximum(mid - 1, low))
    return low


def _stretches(ids: np.ndarray, p: int, first: int, last: int) -> np.ndarray:
    """Rows (begin, end, p) of all stretches of period p of the text at first..last that are long enough, word by word."""
    differ = np.flatnonzero(ids[first : last - p] != ids[first + p : last]) + first
    begin, end = np.append(first, differ + 1), np.append(differ, last - p) + p
    long = end - begin >= max(MIN_WORDS, 2 * p)
    return np.stack((begin[long], end[long], np.full(long.sum(), p)), axis=1)


def _first_of(rows: np.ndarray) -> np.ndarray:
    """The first of rows that agree in their first two columns, after sorting them by three."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def _verified(ids: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``rows`` (begin, end, period) with one row a stretch and every claim of the hashes checked.

    Where the smallest period claimed for a stretch holds, no other period of a run inside it can be but its multiple, so
    it stands for all. Where it fails, the text's stretches of each period claimed there are measured word by word.
    """
    ahead = _first_of(rows)
    wrong = np.array([(ids[b : e - p] != ids[b + p : e]).any() for b, e, p in ahead.tolist()], dtype=bool)
    if not wrong.any():
        return ahead
    bad = {(b, e) for b, e, _ in ahead[wrong].tolist()}
    again = {(first[b], last[b], p) for b, e, p in rows.tolist() if (b, e) in bad}
    return _first_of(np.concatenate([ahead[~wrong], *[_stretches(ids, p, f, t) for f, t, p in sorted(again)]]))


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (text, start in the text, length, period) of all runs, by text, start and period.

    ``ids`` holds the words of all texts as numbers, text i from ``bounds[i]`` to ``bounds[i + 1]``.
    """
    sums, powers = _sums(ids)
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = []
    for low, high in _slices(bounds):
        x, p = grid(bounds, low, high)
        same = np.flatnonzero(ids[x] == ids[x + p])
        x, p = x[same], p[same]
        if not len(x):
            continue
        first, last = bounds[text_of[x]], bounds[text_of[x] + 1]
        after = extensions(sums, powers, x, x + p, last - x - p, 1)
        before = extensions(sums, powers, x, x + p, x - first, -1)
        long = after + before + p >= np.maximum(MIN_WORDS, 2 * p)
        found.append(np.unique(np.stack((x - before, x + p + after, p), axis=1)[long], axis=0))
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    rows = _verified(ids, np.concatenate(found), bounds[text_of], bounds[text_of + 1])
    begin, end, p = rows[:, 0], rows[:, 1], rows[:, 2]
    text = text_of[begin]
    out = np.stack((text, begin - bounds[text], end - begin, p), axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run (start, length, period) contains after its first period."""
    gone = np.zeros(n + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(gone)[:n] == 0


def _groups(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of consecutive texts, WORDS_AT_ONCE or one text at a time."""
    held, size = [], 0
    for text in texts:
        # bytes.split() splits at exactly the six ASCII white space characters
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if held and size + len(words) > WORDS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _find(texts: list[str | None]) -> Iterator[tuple]:
    """(number of words, runs, collapsed text) of each text."""
    for group in _groups(texts):
        flat = [w for words in group for w in words]
        bounds = np.concatenate(([0], np.cumsum([len(words) for words in group]))).astype(np.int64)
        ids = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, dtype=np.int64)
        rows = find_runs(ids, bounds)
        cut = np.searchsorted(rows[:, 0], np.arange(len(group) + 1))
        for i, words in enumerate(group):
            runs = rows[cut[i] : cut[i + 1], 1:]
            left = words
            if len(runs):
                left = [words[j] for j in np.flatnonzero(kept_words(len(words), runs)).tolist()]
            yield len(words), runs, b" ".join(left).decode("utf-8", "surrogatepass")


def runs_of(docs: DataFrame) -> DataFrame:
    """``_row`` (all columns of the input), n_words, runs (by start, then period) and the collapsed text of each document."""
    rows = docs.select(whole_row(docs).alias("_row"), F.col("text").cast("string").alias("text"))
    kind = StructType([rows.schema["_row"], *StructType.fromDDL(FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found = list(_find(batch.column("text").to_pylist()))
            runs = [[dict(start=s, length=k, period=p) for s, k, p in r.tolist()] for _, r, _ in found]
            columns = [pa.array([n for n, *_ in found], pa.int64()), pa.array(runs, each), pa.array([t for *_, t in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns], names=kind.names)

    return rows.mapInArrow(run, kind)


def collapse_documents(docs: DataFrame) -> DataFrame:
    """The documents with every run cut down to its first period, all their columns kept."""
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("_row.text"))
    return runs_of(docs).select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, its longest run, and digests of all runs and of the collapsed text.

    Digests are made where the runs are found, so that no text leaves the worker.
    """
    kind = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def measured(runs: np.ndarray, text: str) -> tuple:
        best = (None,) * 4
        if len(runs):
            start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
            best = (start, length, period, 1000 * length // period)
        return len(runs), *best, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs.tolist())), sha(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in batches:
            found = [measured(runs, text) for _, runs, text in _find(batch.column("text").to_pylist())]
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[x.split()[0] for x in kind.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, kind)
