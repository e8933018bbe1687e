"""Removal of repeated byte strings by a hash-compared suffix sort.

Each byte that is covered by a ``WINDOW``-byte string which also starts earlier (smaller doc_id, or the same document
and an earlier start) is removed; strings are judged on the input and never cross documents.

Sorting every suffix of a corpus would move many times its size, so suffixes are first dealt into buckets: every window
has an anchor, the ``GRAM`` bytes in it with the smallest hash, which depends on the window's bytes alone. Equal windows
have equal anchors at equal offsets, so they meet in their anchor's bucket. The windows of one anchor overlap; together
they are its context, which is one row. In a bucket, contexts with the hash of an earlier one are repeated throughout;
they are checked byte by byte against it, as runs, and should one differ all is done again with other hashes. Where
different contexts remain, the suffixes that start at their windows are sorted by a mergesort whose comparisons find the
common extension of two suffixes by a binary search over prefix polynomial hashes (seven steps), and neighbours that
agree over the whole window are compared byte by byte against collisions. The first of equal windows stays.

A bucket of more than ``MANY`` contexts does not come together: it is split by the bytes that follow before it is
sorted, and equal windows of one task count once. Buckets that hold a large share of all rows are salted until only
their different contexts are left.

Defined results: a null text is empty; a null id comes before all others; rows that repeat an id and a text are one
document and each gets its result; rows that repeat an id only are ordered by a hash of their text; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_hot, release, stored, with_key
from .shingles import mix

WINDOW = 100
GRAM = 32
SPREAD = WINDOW - GRAM + 1
#: Contexts of a bucket that one task sorts at most.
MANY = 5_000
#: Windows of large buckets among which a task looks for equal ones before it sends them on.
HELD = 50_000
#: One document in SAMPLE is asked which buckets are large enough to be salted. This settles routes only, never a result.
SAMPLE = 64
SALTS = 256
#: Runs that one task checks against one document.
TILE = 4096
#: Bytes that are hashed at a time; a longer document is taken in pieces that overlap by a window.
PIECE = 1 << 18
_U = np.uint64
_POSITION = _U((1 << 22) - 1)
_BASE = 0xA0761D6478BD642F
_powers = {"": np.ones(1, dtype=np.uint64)}


@cache
def byte_values(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """What a byte counts for in the hashes of contexts and of anchors."""
    rng = np.random.Generator(np.random.PCG64(77 + seed))
    return tuple(rng.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False) for _ in range(2))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(str(base), _powers[""])
    if len(have) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        _powers[str(base)] = have = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_values(seed)[0][data] * powers(len(data)), out=out[1:])
    return out


def _gram_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """The hash of the GRAM bytes from each position, by doubling."""
    h, width, factor = byte_values(seed)[1][data], 1, 0xE7037ED1A0B428DB
    while width < GRAM:
        h = h[:-width] * _U(factor) + h[width:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        width *= 2
    return mix(h, 3)


def pieces(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document, offset in it, start in the bytes) of consecutive pieces of about PIECE bytes in all."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        data = np.frombuffer(b"".join(p for *_, p in held), dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(p) for *_, p in held])))
        return data, np.asarray([d for d, *_ in held]), np.asarray([o for _, o, _ in held]), starts

    for d, text in enumerate(raw):
        for at in range(0, max(len(text) - WINDOW + 1, 0), PIECE):
            part = text[at : at + PIECE + WINDOW - 1]
            if held and size + len(part) > 2 * PIECE:
                yield joined()
                held, size = [], 0
            held.append((d, at, part))
            size += len(part)
    if held:
        yield joined()


def contexts(data: np.ndarray, doc: np.ndarray, offset: np.ndarray, starts: np.ndarray, seed: int = 0) -> pd.DataFrame:
    """(doc, h, c, at) of each anchor's context; ``at`` packs its start, its windows less one and the anchor's offset."""
    grams = _gram_hashes(data, seed)
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPREAD:
        least = np.minimum(least[: len(least) - (SPREAD - width)], least[SPREAD - width :])
    piece = np.repeat(np.arange(len(doc)), np.diff(starts))
    valid = piece[: len(least)] == piece[WINDOW - 1 :]
    at = np.flatnonzero(valid)
    anchor = (least[at] & _POSITION).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    begin, end = at[first], at[np.append(first[1:], len(at)) - 1]
    anchor = anchor[first]
    sums = prefix_hashes(data, seed)
    # hashes of strings at different places compare after division by the power of the place
    c = (sums[end + WINDOW] - sums[begin]) * powers(len(data) + 1, pow(_BASE, -1, 1 << 64))[begin]
    shape = ((end - begin) * 128 + (anchor - begin)).astype(np.uint64)
    own = piece[begin]
    return pd.DataFrame(
        {
            "doc": doc[own],
            "h": grams[anchor].view(np.int64),
            "c": mix(c ^ mix(shape, 9), 4).view(np.int64),
            "at": (begin - starts[own] + offset[own]) * 16384 + (end - begin) * 128 + (anchor - begin),
        }
    )


def common_extension(sums: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """How many bytes the suffixes at x and y share, up to ``most``."""
    p = powers(len(sums))
    px, py = p[x], p[y]
    sx, sy = sums[x], sums[y]
    low, high = np.zeros(len(x), dtype=np.int64), np.full(len(x), most, dtype=np.int64)
    for _ in range(most.bit_length()):
        mid = (low + high + 1) >> 1
        same = (sums[x + mid] - sx) * py == (sums[y + mid] - sy) * px
        low = np.where(same, mid, low)
        high = np.where(same, high, np.maximum(mid - 1, low))
    return low


def _before(data: np.ndarray, sums: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the window at x comes before, equals or comes after that at y."""
    n = common_extension(sums, x, y)
    whole = n == WINDOW
    a, b = data[np.where(whole, x, x + n)].astype(np.int64), data[np.where(whole, y, y + n)].astype(np.int64)
    return np.where(whole, 0, np.sign(a - b))


def sort_windows(data: np.ndarray, sums: np.ndarray, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The order that sorts windows inside each segment (segments are contiguous), equal ones as they stand.

    A bottom-up mergesort, all segments at once: an element's place in a merge is its place in its run and its rank in
    the other, found by binary search.
    """
    n = len(start)
    seg_first = np.searchsorted(segment, segment, side="left")
    seg_size = np.searchsorted(segment, segment, side="right") - seg_first
    order = np.arange(n)
    width = 1
    while width < (seg_size.max() if n else 0):
        slot = np.flatnonzero(seg_size > width)  # places in segments that still have runs to merge
        inside = slot - seg_first[slot]
        run = inside // width
        left = run % 2 == 0
        other = seg_first[slot] + (run + np.where(left, 1, -1)) * width
        end = seg_first[slot] + seg_size[slot]
        low = np.zeros(len(slot), dtype=np.int64)
        high = np.clip(end - other, 0, width)
        mine = start[order[slot]]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            sign = _before(data, sums, start[order[other[open_] + mid]], mine[open_])
            below = np.where(left[open_], sign < 0, sign <= 0)
            low[open_] = np.where(below, mid + 1, low[open_])
            high[open_] = np.where(below, high[open_], mid)
        target = seg_first[slot] + (run // 2) * 2 * width + inside % width + low
        new = order.copy()
        new[target] = order[slot]
        order = new
        width *= 2
    return order


def repeated_windows(ctx: list[bytes], at: np.ndarray, group: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, from, to) in the document of runs of windows that equal a window of an earlier context of the group."""
    data = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    base = np.concatenate(([0], np.cumsum([len(c) for c in ctx])))[:-1]
    many, offset = at // 128 % 128 + 1, at % 128
    owner = np.repeat(np.arange(len(ctx)), many)
    t = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
    segment = group[owner] * 256 + (offset[owner] - t) + 128
    by = np.argsort(segment, kind="stable")
    owner, t, segment = owner[by], t[by], segment[by]
    start = base[owner] + t
    sums = prefix_hashes(data)
    order = sort_windows(data, sums, start, segment)
    pair = np.flatnonzero(segment[1:] == segment[:-1])  # sorting keeps segments where they are
    x, y = start[order[pair]], start[order[pair + 1]]
    same = common_extension(sums, x, y) == WINDOW
    pair, x, y = pair[same], x[same], y[same]
    repeated = np.zeros(len(owner), dtype=bool)
    repeated[order[pair + 1]] = True
    reach = np.arange(WINDOW)
    for s in range(0, len(x), 20_000):
        wrong = (data[x[s : s + 20_000, None] + reach] != data[y[s : s + 20_000, None] + reach]).any(axis=1)
        for seg in np.unique(segment[pair[s : s + 20_000][wrong]]):
            seen: set[bytes] = set()
            for i in np.flatnonzero(segment == seg):
                window = data[start[i] : start[i] + WINDOW].tobytes()
                repeated[i] = window in seen
                seen.add(window)
    found = np.lexsort((t[repeated], owner[repeated]))
    o, w = owner[repeated][found], t[repeated][found]
    if not len(o):
        return []
    new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1))))
    last = np.append(new[1:], len(o)) - 1
    begin = at[o[new]] // 16384
    return list(zip(o[new].tolist(), (begin + w[new]).tolist(), (begin + w[last] + WINDOW).tolist(), strict=True))


def context_rows(keyed: DataFrame, seed: int) -> DataFrame:
    """(h, c, _id, _tie, at) of every context of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pieces([t.encode("utf-8", "surrogatepass") for t in pdf["text"]]):
                out = contexts(*part, seed)
                out["_id"], out["_tie"] = pdf["_id"].to_numpy()[out["doc"]], pdf["_tie"].to_numpy()[out["doc"]]
                yield out[["h", "c", "_id", "_tie", "at"]]

    return keyed.mapInPandas(run, "h long, c long, _id long, _tie long, at long")


def _judged(keyed: DataFrame, seed: int) -> DataFrame:
    """(h, _id, _tie, at, first, kinds): contexts that repeat an earlier one (``first`` names it), and, without a
    ``first``, the first of each kind in buckets of several kinds."""
    asked = context_rows(keyed.filter(F.pmod(F.xxhash64("_id", "_tie"), F.lit(SAMPLE)) == 0), seed).groupBy("h").count().filter("count > 31")
    asked = stored(asked, "asked")
    total = asked.agg(F.sum("count")).first()[0] or 0
    hot = asked.filter(F.col("count") * HOT_SHARE > total).select("h", F.lit(SALTS).alias("salts"))  # fewer than HOT_SHARE rows
    rows = context_rows(keyed, seed)
    rows = rows.withColumn("salts", F.lit(None).cast("int")) if hot.isEmpty() else rows.join(F.broadcast(hot), "h", "left")
    salted = rows.select("h", "c", "_id", "_tie", "at", F.coalesce(F.pmod(F.xxhash64("_id", "_tie"), "salts"), F.lit(-1)).cast("int").alias("salt"))
    w = Window.partitionBy("h", "salt").orderBy("c", "_id", "_tie", "at")
    place = F.struct("_id", "_tie", "at")
    flagged = salted.withColumn("again", F.coalesce(F.lag("c").over(w) == F.col("c"), F.lit(False)))
    lead = F.last(F.when(~F.col("again"), place), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kinds = F.sum(F.when(F.col("again"), 0).otherwise(1)).over(Window.partitionBy("h", "salt"))
    flagged = flagged.withColumn("kinds", kinds).withColumn("first", F.when(F.col("again"), lead)).filter("again or kinds > 1 or salt >= 0")
    found = stored(flagged.select("h", F.when(F.col("salt") >= 0, F.col("c")).alias("c"), "_id", "_tie", "at", "first", "kinds"), "contexts")
    if hot.isEmpty():
        return found.drop("c")
    # salted buckets: the firsts of their parts, at most SALTS of a kind, find the first of all
    parts = found.filter("c is not null and first is null")
    firsts = stored(parts.groupBy("h", "c").agg(F.min(place).alias("lead"), F.count("*").alias("n")), "firsts")
    sizes = stored(firsts.groupBy("h").agg(F.count("*").alias("all_kinds"), F.sum("n").alias("n")), "sizes")
    known = stored(parts.join(firsts.drop("n"), ["h", "c"]), "parts")
    known = join_hot(known, sizes, "h", "n", known.count())
    known = known.withColumn("first", F.when(place != F.col("lead"), F.col("lead"))).withColumn("kinds", F.col("all_kinds")).filter("first is not null or kinds > 1")
    names = ["h", "_id", "_tie", "at", "first", "kinds"]
    return found.filter("c is null or first is not null").select(*names).unionByName(known.select(*names))


def _sorted_buckets(bytes_rows: DataFrame) -> DataFrame:
    """(_id, _tie, span) of repeated windows in buckets that one task can hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            group = pd.factorize(rows["h"])[0].astype(np.int64)
            found = repeated_windows(rows["ctx"].tolist(), rows["at"].to_numpy(), group)
            i = [x for x, *_ in found]
            out = rows.iloc[i][["_id", "_tie"]]
            return out.assign(span=[s * 256 + e - s for _, s, e in found])

        for pdf in batches:
            for s in range(0, len(pdf), 4_000):
                part = pdf.iloc[s : s + 4_000]
                held.append(part)
                size += len(part)
                if size >= 8_000:
                    rows = pd.concat(held, ignore_index=True)
                    last = rows["h"].iloc[-1]
                    keep = int((rows["h"] == last).to_numpy().argmax())  # the last bucket may go on
                    if keep:
                        yield flush(rows.iloc[:keep].reset_index(drop=True))
                    held, size = [rows.iloc[keep:]], len(rows) - keep
        if size:
            yield flush(pd.concat(held, ignore_index=True))

    dealt = bytes_rows.repartition("h").sortWithinPartitions("h", "_id", "_tie", "at")
    return dealt.mapInPandas(run, "_id long, _tie long, span long")


def runs_of(at: np.ndarray, lead: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(number of the earlier document, begin there, begin here, end here) of contexts that go on where others end."""
    begin, size = at // 16384, at // 128 % 128 + WINDOW
    shift = place // 16384 - begin
    order = np.lexsort((begin, shift, lead))
    out: list[list[int]] = []
    for d, s, b, e in zip(lead[order].tolist(), shift[order].tolist(), begin[order].tolist(), (begin + size)[order].tolist(), strict=True):
        if out and out[-1][:2] == [d, s] and b <= out[-1][3]:
            out[-1][3] = max(e, out[-1][3])
        else:
            out.append([d, s, b, e])
    return [(d, b + s, b, e) for d, s, b, e in out]


def _bytes(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """What is to be compared, by ``kind``: ``run`` (bytes of a run, and where it stands earlier), ``ctx`` (bytes of a
    context, or of one window of a large bucket), and ``gone`` (a window that a task has seen earlier)."""
    known = lambda c, default: F.coalesce(F.col(f"first.{c}"), F.lit(default).cast("long"))
    lead = F.struct("h", "at", (F.col("kinds") > MANY).alias("big"), known("_id", 0).alias("d"), known("_tie", 0).alias("t"), known("at", -1).alias("place"))
    rows = keyed.join(rows.groupBy("_id", "_tie").agg(F.collect_list(lead).alias("s")), ["_id", "_tie"])
    parts = [F.col(f"s.{f}").alias(n) for n, f in ((c, c) for c in ("h", "at", "big", "d", "t", "place"))]
    rows = rows.select("_id", "_tie", "text", *parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held: dict[bytes, tuple[int, int, int]] = {}

        def window(i: int, tie: int, start: int, data: bytes) -> None:
            here = (i, tie, start)
            if (there := held.get(data)) is None:
                held[data] = here
                return
            held[data] = min(here, there)
            i, tie, start = max(here, there)
            out.append(("gone", i, tie, None, start * 16384, None, None, None, None))

        def flush() -> None:
            for data, (i, tie, start) in held.items():
                h = int(mix(prefix_hashes(np.frombuffer(data, dtype=np.uint8))[-1:], 5).view(np.int64)[0])
                out.append(("ctx", i, tie, h, start * 16384, data, None, None, None))
            held.clear()

        for pdf in batches:
            for i, tie, text, hs, ats, bigs, ds, ts, places in pdf.itertuples(index=False):
                raw = text.encode("utf-8", "surrogatepass")
                again = places >= 0
                if again.any():
                    earlier, of = np.unique(np.stack((ds[again], ts[again])), axis=1, return_inverse=True)
                    earlier = earlier.T.tolist()
                    for d, there, b, e in runs_of(ats[again], of, places[again]):
                        out.append(("run", i, tie, None, b, raw[b:e], *earlier[d], there))
                for h, at, big in zip(hs[~again].tolist(), ats[~again].tolist(), bigs[~again].tolist(), strict=True):
                    begin, windows = at // 16384, at // 128 % 128 + 1
                    if big:
                        for start in range(begin, begin + windows):
                            window(i, tie, start, raw[start : start + WINDOW])
                    else:
                        out.append(("ctx", i, tie, h, at, raw[begin : begin + windows - 1 + WINDOW], None, None, None))
                if len(held) > HELD:
                    flush()
                if len(out) >= 10_000:
                    yield frame(out)
                    out.clear()
        flush()
        for s in range(0, len(out), 10_000):
            yield frame(out[s : s + 10_000])

    names = ["kind", "_id", "_tie", "h", "at", "ctx", "lead_id", "lead_tie", "place"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        whole = pd.DataFrame({c: pd.array([r[names.index(c)] for r in rows], dtype="Int64") for c in ("h", "at", "lead_id", "lead_tie", "place")})
        return out.assign(**whole)

    return rows.mapInPandas(run, "kind string, _id long, _tie long, h long, at long, ctx binary, lead_id long, lead_tie long, place long")


def _wrong(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose bytes are not those of the earlier place that their hashes name. A document that many repeat is read in
    tiles of its runs."""
    most = runs.groupBy("lead_id", "lead_tie").count().agg(F.max("count")).first()[0] or 0
    tiled = runs.withColumn("tile", F.pmod(F.xxhash64("_id", "_tie", "at"), F.lit(max(1, math.ceil(most / TILE)))))
    whole = keyed.select(F.col("_id").alias("lead_id"), F.col("_tie").alias("lead_tie"), "text")
    leads = tiled.select("lead_id", "lead_tie", "tile").distinct().join(whole, ["lead_id", "lead_tie"])
    there = F.substring(F.col("text").cast("binary"), F.col("place").cast("int") + 1, F.length("ctx"))
    return tiled.join(leads, ["lead_id", "lead_tie", "tile"]).filter(there != F.col("ctx"))


def spans(keyed: DataFrame) -> DataFrame:
    """(_id, _tie, spans) of each document with repeated bytes; a span packs its start and length."""
    if _repeats(keyed):
        keyed = keyed.dropDuplicates(["_id", "_tie"])
    seed = 0
    while True:
        rows = _judged(keyed, seed)
        unread = stored(_bytes(keyed, rows), "bytes")
        if _wrong(keyed, unread.filter("kind = 'run'")).isEmpty():
            break
        release(unread)
        seed += 1
    packed = lambda at: (F.floor(at / 16384) * 256 + F.floor(at / 128) % 128 + WINDOW).alias("span")
    again = rows.filter("first is not null").select("_id", "_tie", packed(F.col("at")))
    gone = unread.filter("kind = 'gone'").select("_id", "_tie", packed(F.col("at")))
    found = _sorted_buckets(unread.filter("kind = 'ctx'").select("_id", "_tie", "h", "at", "ctx"))
    return again.unionByName(gone).unionByName(found).groupBy("_id", "_tie").agg(F.collect_list("span").alias("spans"))


def _repeats(keyed: DataFrame) -> bool:
    return not keyed.groupBy("_id", "_tie").count().filter("count > 1").limit(1).isEmpty()


def remove(raw: bytes, packed: np.ndarray | None) -> tuple[bytes, int, int]:
    """The bytes outside the spans, and the number of bytes and of maximal runs removed."""
    if packed is None or not len(packed):
        return raw, 0, 0
    begin, size = packed // 256, packed % 256
    change = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + size, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    keyed = with_key(docs, F.col("doc_id").cast("long").alias("doc_id"))
    texts = keyed.select("_id", "_tie", "text")
    joined = keyed.join(spans(texts), ["_id", "_tie"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 500):
                part = pdf.iloc[s : s + 500]
                raw = [t.encode("utf-8", "surrogatepass") for t in part["text"]]
                kept, gone, runs = zip(*[remove(r, p) for r, p in zip(raw, part["spans"], strict=True)], strict=True)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(r) for r in raw], "n_removed": gone, "n_spans": runs, "kept": kept})

    return joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
