"""Language-model scores from a probabilistic suffix tree over words.

A state is a context of the one to ``DEPTH`` words before a word (a document begins with a start sign, and no context
goes beyond it). It is kept where it diverges from the shorter one: where the leave-one-out log-likelihood of the words
seen after it gains more than ``MARGIN`` nats over what the shorter state predicts. A state's next-word distribution is
smoothed with that of the next shorter one in proportion to the number of different words seen after it, down to the
root, a smoothed unigram distribution over the training vocabulary; a word is scored by its longest state.

No model is brought to one place. Words and their contexts are dealt into buckets by the last context word, so a subtree
of the suffix tree is counted, pruned and used for scoring inside one bucket, and only sums per document leave it. What
a very frequent context would bring together is spread out: its rows are dealt by the next longer context, or by
documents where that is as frequent too, and its next words are counted beforehand. Those counts, like those of all words,
lie in parts by ranges of the word's hash, one compressed block for each part and length of context; a part has all that
the test of a frequent context needs of its words, so only sums per context leave it. A bucket asks the parts for what it
needs, in a block each: counts after frequent contexts whose state is kept, and those of rare words. Counts of the
``CODED`` most frequent words are everywhere. Batches of documents send a bucket its rows in one compressed block each;
words are whole in it, frequent ones by their number.

Defined results: a null text is empty and has the end token alone; a null id hashes as the empty text for the split;
repeated rows are scored one by one and all count; an empty table gives an empty result. The first word of a document
has no context. Words that were not seen count one, as in the base score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import mix, sliced, word_hashes

MARGIN = 4.0
DEPTH = 3
TOKENS_A_BUCKET = 1_000_000
#: A context is frequent with more rows than this, and more than one in FREQUENT_SHARE of all, so at most so many are.
FREQUENT_ROWS, FREQUENT_SHARE = 400_000, 1 << 20
#: Most words that are sent by number; their numbers and counts (40 bytes a word) are broadcast.
CODED = 1 << 19
#: Code points of a batch of documents that is encoded together.
BATCH = 8_000_000
FOLDS, HELD_OUT = 7, 2
#: Different words that a task gathers before it sends their counts.
HELD_WORDS = 2_000_000
#: Sums of logarithms are sent as whole multiples of 1 / ONE.
ONE = float(1 << 32)
BLOCKS = "part int, level int, bucket int, data binary"
_U = np.uint64
#: START stands before a document's first word, BEYOND before START.
END, START, BEYOND = _U(0x5BD1E995A3C59AC3), _U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A35)
#: The bits of a hash that say what range it is in.
_TOP = _U(0xFFFFF00000000000)


def held_out(ids: list) -> np.ndarray:
    return np.asarray([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD_OUT for i in ids], dtype=bool)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts one after the other, each with its end token, and where each text's tokens begin."""
    parts = [word_hashes(texts[s:e]) for s, e in sliced(texts)]  # small slices: hashing takes many bytes for each byte
    words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, dtype=np.uint64)
    n = np.concatenate([np.diff(b) for _, b in parts]) if parts else np.zeros(0, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.empty(int(starts[-1]), dtype=np.uint64)
    ends = np.zeros(len(out), dtype=bool)
    ends[starts[1:] - 1] = True
    out[ends] = END
    out[~ends] = words
    return out, starts


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    for pdf in batches:
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        texts = pdf["text"].tolist()
        for s, e in sliced(texts, BATCH):
            yield ids[s:e], texts[s:e]


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges of hashes each one is in."""
    return (((x >> _U(44)) * _U(parts)) >> _U(20)).astype(np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    """The differences of sorted hashes, which compress better; ``np.cumsum`` gives the hashes back."""
    return np.diff(x, prepend=_U(0))


def _ranges(sorted_hashes: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The part and the place of each range that has hashes."""
    at = part_of(sorted_hashes, parts)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    for s, e in zip(first.tolist(), np.append(first, len(at))[1:].tolist(), strict=True):
        yield int(at[s]), slice(s, e)


def _sums(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of each one's counts."""
    found, at = np.unique(keys, return_inverse=True)
    return found, *[np.bincount(at, weights=x, minlength=len(found)).astype(np.int64) for x in counts]


def word_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """(part, level, bucket, data): the tokens of each range of hashes with their counts in training documents, and in all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def blocks() -> Iterator[pd.DataFrame]:
            w, c, n = _sums(*[np.concatenate(x) for x in zip(*held, strict=True)])
            for part, r in _ranges(w, parts):
                yield pd.DataFrame({"part": [part], "data": [_squeeze(_steps(w[r]), _narrow(c[r]), _narrow(n[r]))]})
            held.clear()

        for ids, texts in _batches(batches):
            w, starts = tokens(texts)
            held.append(_sums(w, np.repeat(~held_out(ids), np.diff(starts)), np.ones(len(w), dtype=bool)))
            if sum(len(x[0]) for x in held) > HELD_WORDS:
                yield from blocks()
        if held:
            yield from blocks()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        w, c, n = _sums(*[np.concatenate(x) for x in zip(*[(np.cumsum(w), c, n) for w, c, n in map(_spread, pdf["data"])], strict=True)])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "level": 0, "bucket": -1, "data": [_squeeze(_steps(w), _narrow(c), _narrow(n))]})

    return rows.mapInPandas(run, "part int, data binary").groupBy("part").applyInPandas(merge, BLOCKS)


def word_counts(blocks: DataFrame) -> DataFrame:
    """(w, c, n): how often each token occurs in training documents, and in all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for steps, c, n in map(_spread, pdf["data"]):
                yield pd.DataFrame({"w": np.cumsum(steps).view(np.int64), "c": c.astype(np.int64), "n": n.astype(np.int64)})

    return blocks.mapInPandas(run, "w long, c long, n long")


def _planes(a: np.ndarray) -> bytes:
    """The bytes of ``a``, all first bytes before all second ones and so on, which compress better."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _squeeze(*arrays: np.ndarray) -> bytes:
    head = np.asarray([len(arrays), *[len(a) for a in arrays]], dtype="<i8").tobytes()
    kinds = "".join(a.dtype.str[1:] for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + b"".join(_planes(a) for a in arrays))


def _spread(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    sizes = np.frombuffer(raw, dtype="<i8", count=n, offset=8)
    at = 8 * (n + 1)
    kinds = [raw[at + 2 * i : at + 2 * i + 2].decode() for i in range(n)]
    at += 2 * n
    out = []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        wide = np.dtype(f"<{kind}").itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * wide, offset=at).reshape(wide, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<{kind}").reshape(size))
        at += size * wide
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """Sums of logarithms as whole multiples of 1 / ONE, which add up alike in any order."""
    return np.rint(x * ONE).astype("<u8")


def _narrow(a: np.ndarray) -> np.ndarray:
    most = a.max() if len(a) else 0
    return a.astype("<u2" if most < 65536 else "<u4" if most < 1 << 32 else "<u8")


def preceding(w: np.ndarray, starts: np.ndarray, length: int = DEPTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many words of its document come before each token, and the last, second last, ... of them up to ``length``."""
    at = np.arange(len(w))
    since = at - np.repeat(starts[:-1], np.diff(starts))
    before = [np.where(since >= j, w[np.maximum(at - j, 0)], np.where(since == j - 1, START, BEYOND)) for j in range(1, length + 1)]
    return since, before


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with one more word before it; the empty context is 0."""
    return mix(context * _U(0xD1342543DE82EF95) + word, 31)


BEGUN = longer(np.zeros(1, dtype=np.uint64), np.asarray([START]))[0]


def chained(before: list[np.ndarray]) -> list[np.ndarray]:
    """The hashes of the contexts of length 1, 2, ..."""
    out = [np.zeros(len(before[0]), dtype=np.uint64)]
    for word in before:
        out.append(longer(out[-1], word))
    return out[1:]


def key_of(context: np.ndarray | np.uint64, w: np.ndarray) -> np.ndarray:
    """The hash of a word after a context, in the same range as the word's."""
    return (w & _TOP) | (mix(context * _U(0xE7037ED1A0B428DB) + w, 43) & ~_TOP)


def context_blocks(rows: DataFrame, length: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """(part, level, bucket, data): the words of each range of hashes that follow frequent contexts of a length, with
    the context's place in ``frequent`` and the counts in training documents and in all.

    Of length one, the start sign is counted like a word; it is no state, but the words after it may be.
    """

    def summed(of: np.ndarray, w: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((of, w))
        of, w = of[order], w[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(w), 1), dtype=bool), (w[1:] != w[:-1]) | (of[1:] != of[:-1]))))
        return of[first], w[first], *[np.add.reduceat(x[order].astype(np.int64), first) if len(first) else x[:0].astype(np.int64) for x in (c, n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _batches(batches):
            w, starts = tokens(texts)
            since, before = preceding(w, starts, length)
            at = np.flatnonzero(since >= length - 1)
            ctx = chained([b[at] for b in before])[-1]
            i = np.minimum(np.searchsorted(frequent, ctx), len(frequent) - 1)
            here = frequent[i] == ctx
            at = at[here]
            train = np.repeat(~held_out(ids), np.diff(starts))[at]
            of, w, c, n = summed(i[here], w[at], train, np.ones(len(at), dtype=bool))
            for part, r in _ranges(w, parts):
                yield pd.DataFrame({"part": [part], "data": [_squeeze(_narrow(of[r]), _steps(w[r]), _narrow(c[r]), _narrow(n[r]))]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        of, w, c, n = summed(*[np.concatenate(x) for x in zip(*[(of, np.cumsum(w), c, n) for of, w, c, n in map(_spread, pdf["data"])], strict=True)])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "level": length, "bucket": -1, "data": [_squeeze(_narrow(of), _steps(w), _narrow(c), _narrow(n))]})

    return rows.mapInPandas(run, "part int, data binary").groupBy("part").applyInPandas(merge, BLOCKS)


class Level:
    """The frequent contexts of one length: their hashes in order, those of the contexts one word shorter, how many
    words follow each in training, how many different ones, and whether its state is kept."""

    def __init__(self, ctx: np.ndarray, parent: np.ndarray):
        self.ctx, self.parent = ctx, parent
        self.many, self.kinds, self.kept = np.zeros(len(ctx)), np.zeros(len(ctx)), np.zeros(len(ctx), dtype=bool)


def frequent_sums(table: DataFrame, least: int) -> tuple[pd.DataFrame, list]:
    """(i, many, kinds) of each frequent context, and the (i, w) with more than ``least`` rows; FREQUENT_SHARE rows at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for of, steps, c, n in map(_spread, pdf["data"]):
                i, kinds, many = _sums(of, c > 0, c)
                yield pd.DataFrame({"i": i.astype(np.int64), "w": 0, "many": many, "kinds": kinds})
                often = n > least
                yield pd.DataFrame({"i": of[often].astype(np.int64), "w": np.cumsum(steps)[often].view(np.int64), "many": -1, "kinds": 0})

    found = table.mapInPandas(run, "i long, w long, many long, kinds long")
    summed = found.groupBy("i", "w", (F.col("many") < 0).alias("often")).agg(F.sum("many").alias("many"), F.sum("kinds").alias("kinds")).toArrow().to_pandas()
    often = summed[summed["often"]]
    return summed[~summed["often"]], list(zip(often["i"].tolist(), often["w"].to_numpy(dtype=np.int64).view(np.uint64).tolist(), strict=True))


def gains(tables: DataFrame, levels: list[Level], total: float) -> pd.DataFrame:
    """(i, gain): by how much each frequent context of the last level predicts its words better than the one before it."""
    shared = tables.sparkSession.sparkContext.broadcast(levels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = dict(zip(pdf["level"].tolist(), pdf["data"], strict=True))
        steps, c, _ = _spread(blocks[0])
        keys, loo = key_of(_U(0), np.cumsum(steps)), (c + 1.0) / total
        out = pd.DataFrame({"i": np.zeros(0, dtype=np.int64), "gain": np.zeros(0)})
        for number, level in enumerate(shared.value, start=1):
            if number not in blocks:
                break
            of, steps, c, _ = _spread(blocks[number])
            w, c = np.cumsum(steps), c.astype(np.float64)
            # what follows a context follows the shorter one; that of the start sign is no state and has no longer one
            order = np.argsort(keys)
            given = loo[order[np.searchsorted(keys[order], key_of(level.parent[of], w))]]
            t = level.kinds[of] - (c == 1)
            left = ((c - 1) + t * given) / np.maximum(level.many[of] - 1 + t, 1)
            if number == len(shared.value):
                gain = np.where(c > 0, c * (np.log(np.maximum(left, 1e-300)) - np.log(given)), 0.0)
                i = np.unique(of)
                out = pd.DataFrame({"i": i.astype(np.int64), "gain": np.bincount(of, weights=gain)[i]})
            keys, loo = key_of(level.ctx[of], w), np.where(level.kept[of] & (c > 0), left, given)
        return out

    found = tables.groupBy("part").applyInPandas(run, "i long, gain double")
    return found.groupBy("i").agg(F.sum("gain").alias("gain")).toArrow().to_pandas()  # FREQUENT_SHARE rows at most


class Sums:
    """How many words follow the frequent contexts whose state is kept, and how many different ones."""

    def __init__(self, levels: list[Level]):
        join = lambda x: np.concatenate([np.zeros(0), *[getattr(level, x)[level.kept] for level in levels]])
        ctx = np.concatenate([np.zeros(0, dtype=np.uint64), *[level.ctx[level.kept] for level in levels]])
        order = np.argsort(ctx)
        self.ctx, self.many, self.kinds = ctx[order], join("many")[order], join("kinds")[order]

    def kept(self, ctx: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """The rows whose context is one of these."""
        at = np.flatnonzero(allowed)
        return at[np.isin(ctx[at], self.ctx)]


class Coder:
    """Words by number: the most frequent ones by rank, the others of a block by their place after these."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, all_counts: np.ndarray):
        self.words, self.counts, self.all_counts = words, counts, all_counts
        self.slots = np.full(1 << max(4, (2 * len(words)).bit_length()), -1, dtype=np.int32)  # a word's rank is in the first free slot from its own on
        left, step, own = np.arange(len(words)), 0, self._slot(words)
        while len(left):
            at = (own[left] + step) & (len(self.slots) - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left, step = left[self.slots[at] != left], step + 1

    def _slot(self, w: np.ndarray) -> np.ndarray:
        return ((w * _U(0x9E3779B97F4A7C15)) >> _U(65 - len(self.slots).bit_length())).astype(np.int64)

    def place(self, w: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 of those without."""
        own = self._slot(w)
        out = self.slots[own]
        left, step = np.flatnonzero((out >= 0) & (self.words[out] != w)), 0
        while len(left):
            step += 1
            out[left] = found = self.slots[(own[left] + step) & (len(self.slots) - 1)]
            left = left[(found >= 0) & (self.words[found] != w[left])]
        return out

    def encode(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words without a rank, all words by number)."""
        number = self.place(w)
        rare = np.flatnonzero(number < 0)
        own, at = np.unique(w[rare], return_inverse=True)
        number[rare] = len(self.words) + at
        return own, number

    def decode(self, number: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = self.words[np.minimum(number, len(self.words) - 1)]
        rare = np.flatnonzero(number >= len(self.words))
        out[rare] = own[number[rare] - len(self.words)]
        return out


def frequent_contexts(rows: DataFrame, words_: DataFrame, coder: Coder, n_all: int, total: float, parts: int) -> tuple[list[Level], DataFrame]:
    """The frequent contexts of each length, and the blocks of the counts of words and of what follows these contexts.

    A frequent context is made of words with a number.
    """
    least = max(FREQUENT_ROWS, n_all // FREQUENT_SHARE)
    words = {(w,) for w in coder.words[(coder.all_counts > least) & (coder.words != END)].tolist()} | {(int(START),)}
    tables = words_
    levels: list[Level] = []
    for _ in range(DEPTH):
        hashed = lambda context: chained([np.asarray([x], dtype=np.uint64) for x in context])[-1][0] if context else _U(0)
        named = {int(hashed(context)): context for context in words}
        here = np.asarray(sorted(named), dtype=np.uint64)
        level = Level(here, np.asarray([hashed(named[x][:-1]) for x in here.tolist()], dtype=np.uint64))
        levels.append(level)
        if not len(here):
            continue
        table = stored(context_blocks(rows, len(levels), here, parts), "contexts")
        found, often = frequent_sums(table, least)
        level.many[found["i"]], level.kinds[found["i"]] = found["many"], found["kinds"]
        tables = tables.unionByName(table)
        gain = gains(tables, levels, total)
        level.kept[gain["i"]] = gain["gain"] > MARGIN
        level.kept &= (level.many >= 2) & (here != BEGUN)
        grown = {(w, *named[int(here[i])]) for i, w in often if w != int(END)}
        words = {context for context in grown if context[:-1] in words}
    return levels, tables


def frequent_length(ctx: list[np.ndarray], hot: list[np.ndarray]) -> np.ndarray:
    """The length of each row's longest frequent context."""
    out = np.zeros(len(ctx[0]), dtype=np.int64)
    for length, (c, known) in enumerate(zip(ctx, hot, strict=True), start=1):
        out[(out == length - 1) & np.isin(c, known)] = length
    return out


def _block(columns: list[np.ndarray], doc: np.ndarray, train: np.ndarray, words: np.ndarray, coded: int) -> bytes:
    """Rows that go to one bucket, ordered by the last context word: words by number, ``words`` are those from ``coded`` on."""
    rare = [np.flatnonzero(x >= coded) for x in columns]
    own = np.unique(np.concatenate([x[r] for x, r in zip(columns, rare, strict=True)]))
    if len(own):
        columns = [x.copy() for x in columns]
        for x, r in zip(columns, rare, strict=True):
            x[r] = coded + np.searchsorted(own, x[r])
    last, *rest = columns
    first = np.flatnonzero(np.diff(last, prepend=-1))
    return _squeeze(words[own - coded], _narrow(last[first]), _narrow(np.diff(first, append=len(last))), *map(_narrow, rest), _narrow(doc), np.packbits(train))


def block_of(before: list[np.ndarray], w: np.ndarray, doc: np.ndarray, train: np.ndarray, coder: Coder) -> bytes:
    """The rows of a batch that go to one bucket, ordered by context; all words are kept whole."""
    own, number = coder.encode(np.concatenate([*before, w]))
    columns = np.split(number, DEPTH + 1)
    order = np.lexsort((columns[-1], columns[0]))
    return _block([x[order] for x in columns], doc[order], train, own, len(coder.words))


def read_numbers(data: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(words without a rank; words before, last one first, and word, by number; document; whether each document is for training)."""
    own, last, runs, *rest, doc, train = _spread(data)
    return own, [np.repeat(last, runs).astype(np.int64), *[x.astype(np.int64) for x in rest]], doc.astype(np.int64), np.unpackbits(train)


def read_block(data: bytes, coder: Coder) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(words before, last one first; word; document; whether each document is for training)."""
    own, columns, doc, train = read_numbers(data)
    *before, w = [coder.decode(x, own) for x in columns]
    return before, w, doc, train


class Frequent:
    """Which words are frequent contexts, by number, all frequent contexts, and the sums of those whose state is kept."""

    def __init__(self, coder: Coder, levels: list[Level]):
        self.hot = [level.ctx[level.ctx != BEGUN] for level in levels]
        self.word = np.isin(chained([coder.words])[0], self.hot[0])
        self.sums = Sums(levels)

    def rows(self, last: np.ndarray) -> np.ndarray:
        """The rows after a frequent word, which is the number before them."""
        return np.flatnonzero((last < len(self.word)) & self.word[np.minimum(last, len(self.word) - 1)])


def asks(columns: list[np.ndarray], own: np.ndarray, coder: Coder, frequent: Frequent):
    """What a bucket needs to know: the keys of rows whose word has no number, (rows, keys, sums) of those that follow
    frequent contexts whose state is kept, by length; and the rows after a frequent word with their longest frequent context's length."""
    rare = np.flatnonzero(columns[-1] >= len(coder.words))
    at = frequent.rows(columns[0])
    before = [coder.decode(x[at], own) for x in columns[:-1]]
    w = coder.decode(columns[-1][at], own)
    ctx = chained(before)
    longest = frequent_length(ctx, frequent.hot)
    after = []
    for length, c in enumerate(ctx, start=1):
        kept = frequent.sums.kept(c, longest >= length)
        after.append((at[kept], key_of(c[kept], w[kept]), np.searchsorted(frequent.sums.ctx, c[kept])))
    return rare, key_of(_U(0), own[columns[-1][rare] - len(coder.words)]), after, at, longest


def read_bucket(blocks: list[bytes], coded: int):
    """All rows of a bucket: (words without a rank; words by number; documents of each block; whether each row is for training)."""
    read = [read_numbers(data) for data in blocks]
    own = np.unique(np.concatenate([x[0] for x in read]))
    columns: list[list[np.ndarray]] = [[] for _ in range(DEPTH + 1)]
    for words, numbers, _, _ in read:
        into = np.searchsorted(own, words)
        for i, x in enumerate(numbers):
            rare = np.flatnonzero(x >= coded)
            x[rare] = coded + into[x[rare] - coded]
            columns[i].append(x.astype(np.int32))
    docs, train = [x[2] for x in read], [x[3][x[2]].astype(bool) for x in read]
    del read
    return own, [np.concatenate(x) for x in columns], docs, np.concatenate(train)


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct value, the place of each row's value)."""
    order = np.argsort(x)
    new = np.diff(x[order], prepend=x[order[:1]] - x.dtype.type(1)) != 0
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def score_bucket(columns: list[np.ndarray], n_words: int, train: np.ndarray, p: np.ndarray, loo: np.ndarray, longest: np.ndarray):
    """(log10 of each row's word's chance, count of its last context word in training, if that is not frequent).

    ``p`` and ``loo`` are the chances after the longest frequent context, of length ``longest``, and are changed. A context that
    occurs once in training has no state, and no longer one has.
    """
    *before, w = columns
    at = np.flatnonzero(before[0] != 0)  # the start sign
    context = before[0][at].astype(np.int64)
    count = np.zeros(len(w))
    for length in range(1, len(before) + 1):
        if length > 1:
            word = before[length - 1][at]
            inside = word != 1  # before the start sign
            at, context = at[inside], context[inside] * n_words + word[inside]
        first, of = _grouped(context)
        many = np.bincount(of, weights=train[at], minlength=len(first))
        if length == 1:
            count[at] = many[of]
        again = (many[of] >= 2) | (longest[at] >= length)
        at, of = at[again], of[again]
        state = np.flatnonzero(longest[at] < length)
        _state(at[state], of[state], many, w, n_words, train, p, loo)
        context = of
    return np.log10(p), count


def _state(at: np.ndarray, of: np.ndarray, many: np.ndarray, w: np.ndarray, n_words: int, train: np.ndarray, p: np.ndarray, loo: np.ndarray) -> None:
    """Put the chances under states of one length, in use and leave-one-out, of rows ``at`` with contexts ``of`` in place
    of those under the shorter ones, where a state is kept."""
    if not len(at):
        return
    first, pair = _grouped(of * n_words + w[at])
    n = np.bincount(pair, weights=train[at], minlength=len(first))
    context, given = of[first], loo[at[first]]
    kinds = np.bincount(context, weights=n > 0, minlength=len(many))
    # leave one out: the pair and its context once less, and the pair unseen if that was its only time
    t = kinds[context] - (n == 1)
    left = ((n - 1) + t * given) / np.maximum(many[context] - 1 + t, 1)
    gain = np.where(n > 0, n * (np.log(np.maximum(left, 1e-300)) - np.log(given)), 0.0)
    kept = np.bincount(context, weights=gain, minlength=len(many)) > MARGIN
    use = np.flatnonzero(kept[of])
    at, of, pair = at[use], of[use], pair[use]
    p[at] = (n[pair] + kinds[of] * p[at]) / np.maximum(many[of] + kinds[of], 1)
    loo[at] = np.where(n[pair] > 0, left[pair], loo[at])


def frequent_words(counts: DataFrame) -> pd.DataFrame:
    """(w, c, n) of the most frequent words, ``CODED`` at most: all from such a frequency on as lets them fit."""
    step = F.floor(16 * F.log2("n")).cast("int")
    bins = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)  # at most 16 * 64 rows
    least, many = 1 << 20, 0
    for r in bins:
        many += r["count"]
        if many > CODED:
            break
        least = r["step"]
    return counts.filter(step >= least).toArrow().to_pandas()


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = 4 * max(1, rows.rdd.getNumPartitions())
    blocks = stored(word_blocks(rows, parts), "words")
    counts = word_counts(blocks)
    s = counts.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train, n_all, n_words = s["c"] or 0, s["n"] or 0, s["v"]
    buckets = max(1, -(-n_all // TOKENS_A_BUCKET))
    total = n_train + n_words + 1.0
    # the signs are coded first, then words from a frequency on; what is rarer is asked for
    top = frequent_words(counts).sort_values(["n", "w"], ascending=[False, True])
    words = np.concatenate((np.asarray([START, BEYOND], dtype=np.uint64), top["w"].to_numpy(dtype=np.int64).view(np.uint64)))
    coded = Coder(words, *[np.concatenate(([0, 0], top[x].to_numpy(dtype=np.int64))) for x in ("c", "n")])
    levels, tables = frequent_contexts(rows, blocks, coded, n_all, total, parts)
    shared = spark.sparkContext.broadcast((coded, Frequent(coded, levels)))

    def bucket_of(ctx: np.ndarray) -> np.ndarray:
        return (mix(ctx, 41) % _U(buckets)).astype(np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, frequent = shared.value
        n_coded = len(coder.words)
        of_coded = bucket_of(chained([coder.words])[0])
        task = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_batches(batches)):
            batch = task * 10**6 + number
            w, starts = tokens(texts)
            train = ~held_out(ids)
            known_ids = np.asarray([i is not None for i in ids], dtype="<u1")
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))
            own, place = coder.encode(w)
            del w
            # the base score of words with a number; that of the others is summed up where they are the last context word
            c = np.concatenate((coder.counts, np.zeros(len(own), dtype=np.int64)))[place]
            base = np.bincount(doc, weights=np.log10(c + 1.0), minlength=len(ids)), np.bincount(doc, weights=c > 0, minlength=len(ids)).astype("<i8")
            head = _squeeze(np.asarray([i or 0 for i in ids], dtype="<i8"), known_ids, np.diff(starts).astype("<i8"), base[0].astype("<f8"), base[1])
            yield pd.DataFrame({"batch": [batch], "bucket": [batch % buckets], "head": [True], "data": [head]})
            del c
            at = np.arange(len(place))
            since = at - np.repeat(starts[:-1], np.diff(starts))
            # the numbers of the signs are 0 and 1
            columns = [np.where(since >= j, place[np.maximum(at - j, 0)], (since < j - 1).astype(np.int32)) for j in range(1, DEPTH + 1)]
            del at
            # the shortest context that is not frequent says where a row goes; without one it may go anywhere
            bucket = np.concatenate((of_coded, bucket_of(chained([own])[0])))[columns[0]]
            bucket[since == 0] = batch % buckets
            del since
            hot = frequent.rows(columns[0])
            ctx = chained([coder.decode(x[hot], own) for x in columns])
            longest = frequent_length(ctx, frequent.hot)
            bucket[hot] = np.where(longest == DEPTH, batch % buckets, bucket_of(np.choose(np.minimum(longest, DEPTH - 1), ctx)))
            del hot, ctx, longest
            many = n_coded + len(own)
            order = np.argsort((bucket * many + columns[0]) * many + place)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            del bucket
            columns, doc = [x[order] for x in (*columns, place)], doc[order]
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    o = slice(cuts[b], cuts[b + 1])
                    yield pd.DataFrame({"batch": [batch], "bucket": [b], "head": [False], "data": [_block([x[o] for x in columns], doc[o], train, own, n_coded)]})

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        coder, frequent = shared.value
        found = [np.zeros(0, dtype=np.uint64)]
        for data in pdf.loc[~pdf["head"], "data"]:
            own, columns, *_ = read_numbers(data)
            _, keys, after, *_ = asks(columns, own, coder, frequent)
            found.append(np.unique(np.concatenate([keys, *[x[1] for x in after]])))
        keys = np.unique(np.concatenate(found))
        sent = [(part, _squeeze(_steps(keys[r]))) for part, r in _ranges(keys, parts)]
        return pd.DataFrame({"part": pd.array([x[0] for x in sent], dtype="int32"), "level": -1, "bucket": pdf["bucket"].iloc[0], "data": [x[1] for x in sent]})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        known = [np.zeros(0, dtype=np.uint64)]
        counts = [np.zeros(0, dtype=np.int64)]
        for level, data in pdf.loc[pdf["level"] >= 0, ["level", "data"]].itertuples(index=False):
            if level == 0:
                steps, c, _ = _spread(data)
                known.append(key_of(_U(0), np.cumsum(steps)))
            else:
                of, steps, c, _ = _spread(data)
                kept = levels[level - 1].kept[of]
                known.append(key_of(levels[level - 1].ctx[of[kept]], np.cumsum(steps)[kept]))
                c = c[kept]
            counts.append(c.astype(np.int64))
        keys, c = np.concatenate(known), np.concatenate(counts)
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        asked = pdf.loc[pdf["level"] < 0, ["bucket", "data"]]
        told = [_squeeze(_narrow(c[np.searchsorted(keys, np.cumsum(_spread(data)[0]))])) for data in asked["data"]]
        return pd.DataFrame({"part": pdf["part"].iloc[0], "bucket": asked["bucket"].to_numpy(), "data": told})

    def score(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        coder, frequent = shared.value
        rows_ = pdf.loc[~pdf["head"], ["batch", "data"]]
        out = [pdf.loc[pdf["head"], ["batch", "head", "data"]]]
        if not len(rows_):
            return out[0]
        own, columns, docs_of, train = read_bucket(rows_["data"].tolist(), len(coder.words))
        rare, keys, after, at, longest_at = asks(columns, own, coder, frequent)
        _, place = np.unique(np.concatenate([keys, *[x[1] for x in after]]), return_inverse=True)
        answers = [_spread(data)[0].astype(np.int64) for data in told.sort_values("part")["data"]]
        counts = np.concatenate([np.zeros(0, dtype=np.int64), *answers])[place]
        c0 = coder.counts[np.minimum(columns[-1], len(coder.words) - 1)]
        c0[rare] = counts[: len(rare)]
        p = (c0 + 1.0) / total
        loo = p.copy()
        del c0
        done = len(rare)
        for rows_at, _, of in after:
            c = counts[done : done + len(rows_at)]
            done += len(rows_at)
            many, kinds = frequent.sums.many[of], frequent.sums.kinds[of]
            t = kinds - (c == 1)
            left = ((c - 1) + t * loo[rows_at]) / np.maximum(many - 1 + t, 1)
            p[rows_at] = (c + kinds * p[rows_at]) / np.maximum(many + kinds, 1)
            loo[rows_at] = np.where(c > 0, left, loo[rows_at])
        longest = np.zeros(len(p), dtype=np.int8)
        longest[at] = longest_at
        del after, place, counts
        lp, count = score_bucket(columns, len(coder.words) + len(own), train, p, loo, longest)
        uncoded = columns[0] >= len(coder.words)
        start = 0
        for batch, doc in zip(rows_["batch"].tolist(), docs_of, strict=True):
            span = slice(start, start + len(doc))
            start += len(doc)
            many = np.bincount(doc)
            name = np.flatnonzero(many)
            parts_ = [_narrow(name), _whole(-np.bincount(doc, weights=lp[span])[name])]
            name, i = np.unique(doc[uncoded[span]], return_inverse=True)
            c = count[span][uncoded[span]]
            parts_ += [_narrow(name), _whole(np.bincount(i, weights=np.log10(c + 1))), _narrow(np.bincount(i, weights=c > 0).astype(np.int64))]
            out.append(pd.DataFrame({"batch": [batch], "head": [False], "data": [_squeeze(*parts_)]}))
        return pd.concat(out, ignore_index=True)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, known_ids, n, base, known = _spread(pdf.loc[pdf["head"], "data"].iloc[0])
        score_, rare_base, known = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64), known.copy()
        for data in pdf.loc[~pdf["head"], "data"]:
            own, lp, rare, logs, seen = _spread(data)
            score_[own] -= lp.astype(np.int64)
            rare_base[rare] += logs.astype(np.int64)
            known[rare] += seen
        name = [int(i) if k else None for i, k in zip(ids, known_ids, strict=True)]
        return pd.DataFrame(
            {
                "doc_id": pd.array(name, dtype="Int64"),
                "held_out": held_out(name),
                "n_tokens": n,
                "n_known": known,
                "train_tokens": n_train,
                "base_score": base + rare_base / ONE - n * np.log10(n_train + n_words + 1.0),
                "score": score_ / ONE,
            }
        )

    # dealt is shuffled once: the plan reuses its exchange for what buckets ask for
    dealt = rows.mapInPandas(deal, "batch long, bucket int, head boolean, data binary").repartition(buckets, "bucket")
    asked = dealt.groupBy("bucket").applyInPandas(ask, BLOCKS)
    told = asked.unionByName(tables).groupBy("part").applyInPandas(answer, "part int, bucket int, data binary")
    sums = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(score, "batch long, head boolean, data binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sums.groupBy("batch").applyInPandas(combine, schema)
