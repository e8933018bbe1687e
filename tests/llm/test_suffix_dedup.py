import hashlib
import random

import numpy as np
import pytest

from linkloom.llm import suffix_dedup as sd

from .helpers import DOCS, awkward, table


def brute(docs):
    """docs: [(id, text)] in order -> [(id, bytes, removed, spans, kept)]."""
    seen, out = set(), []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(15, 60))) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and out:
            t = rng.choice(out)
            i = rng.randrange(len(t) + 1)
            out.append(t[:i] + rng.choice(["", "!", word()]) + t[i:])
        elif kind < 0.4:
            out.append(rng.choice(["ab", "x", "abc "]) * rng.randrange(20, 200))
        else:
            own = lambda: " ".join(word() for _ in range(rng.randrange(0, 40)))
            out.append(own() + " " + rng.choice(passages) + " " + own() + rng.choice(passages)[: rng.randrange(200)])
    return out


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    ts = corpus(seed)
    assert result(sd.deduplicate(table(spark, ts))) == sorted(brute(enumerate(ts)), key=str)


def test_large_buckets_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "MANY", 3)
    ts = corpus(5)
    assert result(sd.deduplicate(table(spark, ts))) == sorted(brute(enumerate(ts)), key=str)


def test_hot_buckets_are_salted(spark, monkeypatch):
    monkeypatch.setattr(sd, "SAMPLE", 1)
    monkeypatch.setattr(sd, "SALTS", 3)
    rng = random.Random(4)
    page = " ".join(f"line {i} of a page that many documents hold" for i in range(6))
    ts = [page if rng.random() < 0.6 else f"{page[: rng.randrange(90, len(page))]} own {i} {page}" for i in range(90)] + corpus(8, 30)
    for many in (5_000, 2):
        monkeypatch.setattr(sd, "MANY", many)
        assert result(sd.deduplicate(table(spark, ts))) == sorted(brute(enumerate(ts)), key=str)


def test_runs_are_checked_by_bytes(spark):
    keyed = spark.createDataFrame([(1, 0, "é" + "a" * 150), (2, 0, "a" * 150)], "_id long, _tie long, text string")
    runs = [(2, 0, 0, b"a" * 120, 1, 0, 2), (2, 0, 0, b"a" * 119 + b"b", 1, 0, 2), (2, 0, 0, b"a" * 120, 1, 0, 1)]
    found = sd._wrong(keyed, spark.createDataFrame(runs, "_id long, _tie long, at long, ctx binary, lead_id long, lead_tie long, place long")).collect()
    assert sorted(bytes(r["ctx"])[-1:] + bytes([r["place"]]) for r in found) == [b"a\1", b"b\2"]
    at = np.asarray([0, 60, 300]) * 16384
    assert sorted(sd.runs_of(at, np.asarray([0, 0, 0]), at + 5 * 16384)) == [(0, 5, 0, 160), (0, 305, 300, 400)]


def test_long_documents_are_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 500)
    raw = [t.encode() for t in corpus(7)]
    windows = 0
    for part in sd.pieces(raw):
        out = sd.contexts(*part)
        windows += int((out["at"] // 128 % 128 + 1).sum())
    assert windows == sum(max(0, len(r) - 99) for r in raw)


def test_sorting_windows():
    rng = np.random.Generator(np.random.PCG64(3))
    data = np.frombuffer(bytes(rng.integers(97, 99, 3000).tolist()) + b"a" * 600 + b"ab" * 300, dtype=np.uint8)
    start = rng.integers(0, len(data) - 100, 700)
    segment = np.sort(rng.integers(0, 9, 700))
    order = sd.sort_windows(data, sd.prefix_hashes(data), start, segment)
    key = [(int(g), data[s : s + 100].tobytes(), i) for i, (g, s) in enumerate(zip(segment, start, strict=True))]
    assert order.tolist() == [k[2] for k in sorted(key)]


def test_awkward(spark):
    docs = awkward(spark)
    rows = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    want = brute(order)
    repeated = [w for w, r in zip(want, order, strict=True) for _ in range(docs.filter(docs.doc_id.eqNullSafe(r[0]) & docs.text.eqNullSafe(r[1] if r[1] or r[0] != 1 else None)).count())]
    assert result(sd.deduplicate(docs)) == sorted(repeated, key=str)
    assert sd.deduplicate(spark.createDataFrame([], DOCS)).count() == 0
