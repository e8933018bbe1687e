import hashlib
import random

import numpy as np
import pytest

from linkloom.llm import periodic_runs as pr
from linkloom.llm.queries import planted

from .helpers import DOCS, awkward, table


def brute(w):
    """Every maximal stretch of every period, the smallest period of each stretch."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def collapsed(w, runs):
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(rng):
    base = [rng.choice("abcdefghij"[: rng.choice([1, 2, 3, 10])]) for _ in range(rng.randrange(50))]
    kind = rng.random()
    if kind < 0.4:
        base = base * rng.randrange(1, 5) + base[:3]
    elif kind > 0.9:
        base = [str(bin(i).count("1") % 2) for i in range(rng.randrange(400))]
    return base


def numbers(texts):
    known: dict = {}
    ids = np.array([known.setdefault(x, len(known)) for t in texts for x in t], dtype=np.int64)
    return ids, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = [words(rng) for _ in range(rng.randrange(1, 6))]
        assert pr.find_runs(*numbers(texts)).tolist() == [[i, *r] for i, t in enumerate(texts) for r in brute(t)]


def test_many_slices(monkeypatch):
    monkeypatch.setattr(pr, "PAIRS_AT_ONCE", 16)
    rng = random.Random(4)
    texts = [words(rng) for _ in range(12)]
    assert pr.find_runs(*numbers(texts)).tolist() == [[i, *r] for i, t in enumerate(texts) for r in brute(t)]


def test_hashes_that_collide(monkeypatch):
    """With every hash equal, all claims are wrong where words differ, and measuring word by word finds the same runs."""
    monkeypatch.setattr(pr, "_sums", lambda ids: (np.zeros(len(ids) + 1, dtype=np.uint64), np.ones(len(ids) + 1, dtype=np.uint64)))
    rng = random.Random(5)
    for _ in range(40):
        texts = [words(rng)]
        assert pr.find_runs(*numbers(texts)).tolist() == [[0, *r] for r in brute(texts[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_and_collapse(spark, seed):
    rng = random.Random(seed)
    texts = [rng.choice([" ", "\n", "\t "]).join(words(rng)) for _ in range(60)] + ["", None, "x " * 5000]
    docs = table(spark, texts)
    found = {r["doc_id"]: r for r in pr.report(docs).collect()}
    kept = {r["doc_id"]: r["text"] for r in pr.collapse_documents(docs).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        runs = brute(w) if i < len(texts) - 1 else [(0, 5000, 1)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        r = found[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        assert kept[i] == (collapsed(w, runs) if runs else t)


def test_planted(spark):
    import zlib

    texts = [" ".join(f"w{i * j % 37}" for j in range(i % 90)) for i in range(120)]
    got = {r["doc_id"]: r["text"] for r in planted(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, h = t.split(), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert got[i].split() == [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        else:
            assert got[i] == t


def test_awkward(spark):
    docs = awkward(spark)
    rows = pr.runs_of(docs).collect()
    assert len(rows) == 10
    assert [r["n_words"] for r in rows if r["_row"]["doc_id"] in (1, 2, 6)] == [0, 0, 0]
    again = pr.collapse_documents(docs)
    assert again.columns == docs.columns
    assert again.count() == 10
    assert [r["n_runs"] for r in pr.report(docs).filter("doc_id is null").collect()] == [1]  # three times five words


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert pr.report(docs).count() == 0
    assert pr.collapse_documents(docs).count() == 0
