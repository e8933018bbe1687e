"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line ends, after sentence ends, and, so that a long run of words is not one
paragraph, after a word whose hash says so. Each paragraph (with its how-manyth occurrence in the text) has a 64-bit
digest. The sketch is a table of cells; a paragraph adds its count, digest, checksum and length to three of them.
Subtracting two sketches cell by cell cancels what the texts share; peeling cells that hold a single paragraph recovers
the digests that differ. A sketch too small for the difference does not peel to the end; then both texts are sketched
again in a larger table, sized by the estimate that the failed table gives and at least doubled, until peeling succeeds.

The likeness of two sketches is the length of the paragraphs they share over the length of all (0 to 1); two empty
texts are alike (1).

Defined results: a null text is empty; documents follow each other by ascending doc_id (null first, equal ids by text)
and the last is followed by the first; a single document follows itself; an empty table gives an empty result; repeated
rows are documents of their own.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import let

#: Cells of the sketch that is returned, a multiple of HASHES.
CELLS = 12
HASHES = 3
#: One word in so many ends a paragraph, on average.
WORDS_A_PARAGRAPH = 12
#: Documents of a run, about, and the most runs (beyond that, runs grow).
DOCS_PER_RUN, MAX_RUNS = 4_000, 8_192
_PARAGRAPH = re.compile(r"[^\n.!?]*[\n.!?]+\s*|[^\n.!?]+\Z")
_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text; joined, they are the text again."""
    out = []
    for p in _PARAGRAPH.findall(text):
        if len(p) <= 8 * WORDS_A_PARAGRAPH:
            out.append(p)
            continue
        start = 0
        for m in re.finditer(r"\S+\s*", p):
            # a word's own content decides, so the same words are cut alike in another text
            if _ends_paragraph(m[0].rstrip()) and m.end() < len(p):
                out.append(p[start : m.end()])
                start = m.end()
        out.append(p[start:])
    return out


_word_ends: dict[str, bool] = {}


def _ends_paragraph(word: str) -> bool:
    found = _word_ends.get(word)
    if found is None:
        if len(_word_ends) >= 200_000:
            _word_ends.clear()
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=2).digest()
        found = _word_ends[word] = int.from_bytes(digest, "big") % WORDS_A_PARAGRAPH == 0
    return found


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, digest, length) of every paragraph; the digest also covers which occurrence in its text it is."""
    owners: list[int] = []
    raw: list[bytes] = []
    sizes: list[int] = []
    for i, t in enumerate(texts):
        found = paragraphs(t)
        owners += [i] * len(found)
        raw += [hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest() for p in found]
        sizes += map(len, found)
    owner = np.asarray(owners, dtype=np.int64)
    key = np.frombuffer(b"".join(raw), dtype="<u8").astype(np.uint64) if raw else np.zeros(0, dtype=np.uint64)
    order = np.lexsort((key, owner))
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    at = np.arange(len(key))
    nth = np.empty(len(key), dtype=np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return owner, np.where(nth > 0, _mix(key, 5) + _mix(nth.astype(np.uint64), 6), key), np.asarray(sizes, dtype=np.int64)


class Sketches:
    """Sketches of many texts, of ``cells[i]`` cells each, one after the other in four arrays."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.start = np.concatenate(([0], np.cumsum(cells)))
        n = int(self.start[-1])
        self.count, self.size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.key, self.check = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)

    def places(self, owner: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        part = (self.cells[owner] // HASHES).astype(np.uint64)
        return [self.start[owner] + j * part.astype(np.int64) + (_mix(key, 10 + j) % part).astype(np.int64) for j in range(HASHES)]

    def add(self, owner: np.ndarray, key: np.ndarray, size: np.ndarray, sign: int | np.ndarray = 1) -> None:
        """Sums are modulo 2 ** 64, so that adding and subtracting cancel."""
        signs = np.broadcast_to(np.asarray(sign, dtype=np.int64), owner.shape)
        as_u = signs.astype(np.uint64)
        check = _mix(key, 3)
        for at in self.places(owner, key):
            np.add.at(self.count, at, signs)
            np.add.at(self.size, at, signs * size)
            np.add.at(self.key, at, as_u * key)
            np.add.at(self.check, at, as_u * check)

    def text(self, i: int) -> str:
        """One sketch as it is returned: base64 of its cells."""
        s = slice(int(self.start[i]), int(self.start[i + 1]))
        parts = (self.count[s].astype("<u4"), self.size[s].astype("<u4"), self.key[s].astype("<u8"), (self.check[s] >> _U(32)).astype("<u4"))
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Of difference sketches: the length of the paragraphs that differ in each, and whether it peeled to the end."""
        differ = np.zeros(len(self.cells), dtype=np.int64)
        whose = np.repeat(np.arange(len(self.cells)), self.cells)
        look = np.arange(len(whose))
        while len(look):
            c = self.count[look]
            key = np.where(c == 1, self.key[look], _U(0) - self.key[look])
            check = np.where(c == 1, self.check[look], _U(0) - self.check[look])
            pure = (np.abs(c) == 1) & (check == _mix(key, 3))
            at, key, c = look[pure], key[pure], c[pure]
            if not len(at):
                break
            owner, size = whose[at], np.abs(self.size[at])
            # a paragraph may stand alone in several of its cells
            _, one = np.unique(np.stack([owner.astype(np.uint64), key]), axis=1, return_index=True)
            owner, key, size, c = owner[one], key[one], size[one], c[one]
            np.add.at(differ, owner, size)
            self.add(owner, key, size, -c)
            look = np.unique(np.concatenate(self.places(owner, key)))
        left = np.zeros(len(self.cells), dtype=bool)
        odd = (self.count != 0) | (self.key != 0) | (self.check != 0)
        left[whose[odd]] = True
        return differ, ~left


def likeness(pairs: np.ndarray, owner: np.ndarray, key: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Likeness of each pair (a, b) of the ``n`` texts whose paragraphs are given."""
    total = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
    many = np.bincount(owner, minlength=n)
    first = np.concatenate(([0], np.cumsum(many)))
    differ = np.zeros(len(pairs), dtype=np.int64)
    cells = np.full(len(pairs), CELLS, dtype=np.int64)
    todo = np.arange(len(pairs))
    while len(todo):
        sketches = Sketches(cells[todo])
        for side, sign in ((0, 1), (1, -1)):
            docs = pairs[todo, side]
            reps = many[docs]
            at = np.repeat(first[docs] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(int(reps.sum()))
            sketches.add(np.repeat(np.arange(len(todo)), reps), key[at], size[at], sign)
        spread = np.add.reduceat(sketches.count**2, sketches.start[:-1])
        found, done = sketches.peel()
        differ[todo[done]] = found[done]
        # cells of a table too small: their squared counts add up to about HASHES a differing paragraph
        guess = 2 * spread[~done] // HASHES
        todo = todo[~done]
        guess = np.minimum(guess, 2 * (many[pairs[todo, 0]] + many[pairs[todo, 1]]))  # no more than all can differ
        cells[todo] = np.maximum(2 * cells[todo], (guess // HASHES + 1) * HASHES)
    both = total[pairs[:, 0]] + total[pairs[:, 1]]
    shared = (both - differ) / 2
    return np.where(both > 0, shared / np.maximum(both - shared, 1), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first code points of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(texts: list[str], following: list[str]) -> dict[str, list]:
    """The result columns of documents and of those that follow them."""
    n = len(texts)
    new = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    owner, key, size = digests([*texts, *new, *following])
    shown = Sketches(np.full(2 * n, CELLS, dtype=np.int64))
    own = owner < 2 * n
    shown.add(owner[own], key[own], size[own])
    i = np.arange(n)
    alike = likeness(np.concatenate([np.stack([i, i + n], 1), np.stack([i, i + 2 * n], 1)]), owner, key, size, 3 * n)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        "fingerprint": [shown.text(k) for k in range(n)],
        "edited_fingerprint": [shown.text(n + k) for k in range(n)],
        "near_edited": alike[:n],
        "near_next": alike[n:],
    }


def _run_of(ids: Column, low: int, high: int, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most the id: a table of equal cells narrows the search to a few of them."""
    cells = 4 * len(cuts) + 1
    width = (high - low + 1) / cells
    # a cell either side makes up for rounding
    begin = [bisect.bisect_left(cuts, math.floor(low + (c - 1) * width)) for c in range(cells)]
    count = [bisect.bisect_right(cuts, math.ceil(low + (c + 2) * width)) - b for c, b in enumerate(begin)]
    literal = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<bigint>")
    bounds, begins, counts = literal(cuts), literal(begin), literal(count)
    cell = F.least(F.greatest(F.floor((ids.cast("double") - low) / width), F.lit(0)), F.lit(cells - 1)).cast("int")

    def search(c: Column) -> Column:
        near = F.slice(bounds, (F.get(begins, c) + 1).cast("int"), F.get(counts, c).cast("int"))
        return (F.get(begins, c) + F.size(F.filter(near, lambda b: b <= ids))).cast("int")

    return let(cell, search)


def _in_order(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text): documents in runs of ids, each run followed by the first document of the next.

    Bounds of the runs are ids themselves (approximate quantiles), so that the first document of a run is known by its
    id; ``part`` is 1 for that extra copy. There are at most MAX_RUNS runs, each a partition that is sorted and streamed.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    s = rows.agg(F.count("*").alias("n"), F.min("_id").alias("low"), F.max("_id").alias("high")).first()
    n = min(MAX_RUNS, max(1, -(-s["n"] // DOCS_PER_RUN)))
    found = rows.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else []
    cuts = sorted(set(found) - {s["low"]})
    run = _run_of(F.col("_id"), s["low"], s["high"], cuts) if cuts else F.lit(0)
    lowest = F.col("_id") == s["low"] if s["n"] else F.lit(False)
    own = F.struct(F.col("run").alias("run"), F.lit(0).alias("part"))
    ahead = F.struct(F.when(lowest, F.lit(len(cuts))).otherwise(F.col("run") - 1).alias("run"), F.lit(1).alias("part"))
    starts = F.col("_id").isin(cuts) | lowest
    copies = F.when(starts, F.array(own, ahead)).otherwise(F.array(own))
    spread = rows.withColumn("run", run).select(F.explode(copies).alias("at"), "doc_id", "_id", "text").select("at.*", "doc_id", "_id", "text")
    return spread.repartitionById(len(cuts) + 1, F.col("run")).sortWithinPartitions("part", "_id", "text").select("part", "doc_id", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: tuple | None = None  # a document whose next one is not here yet
        for pdf in batches:
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            rows = list(zip(pdf["part"].tolist(), ids, pdf["text"].tolist(), strict=True))
            if waiting is not None:
                rows.insert(0, waiting)
            # the first extra copy closes the run; any others (equal ids) come after it in order
            end = next((i for i, r in enumerate(rows) if r[0] == 1), len(rows) - 1)
            waiting = rows[end] if end >= 0 and rows[end][0] == 0 else None
            closed = rows[end][0] == 1 if rows else False
            texts = [r[2] for r in rows[: end + 1]]
            for part in slices(texts[:end], 1_000_000):
                out = compare(texts[part], texts[part.start + 1 : part.stop + 1])
                yield pd.DataFrame({"doc_id": pd.array([r[1] for r in rows[part]], dtype="Int64"), **out})
            if closed:
                for _ in batches:
                    pass
                return

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs).mapInPandas(run, schema)
