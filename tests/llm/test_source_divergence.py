import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkloom.llm import source_divergence as sd

from .helpers import DOCS, awkward

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, most=200):
    """rows: (lang, source, text) -> the audit's rows, by Python's whole numbers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        groups = {s: {t: c[t] for t in kept} for (k, s), c in counts.items() if k == lang}
        share = lambda own: {t: 1 + 10**9 * (own[t] + 1) // (sum(own.values()) + len(kept)) for t in kept}
        p = {s: share(own) for s, own in groups.items()}
        q = share({t: sum(own[t] for own in groups.values()) for t in kept})
        for s in groups:
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s))
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:most]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def corpus(seed, n=150, sources=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", None])
        source = rng.choice([None, *[f"s{k}" for k in range(sources)]]) if rng.random() < 0.7 else "big"
        word = lambda: rng.choice(["the", "The", "of", "Zürich", "日本", f"w{rng.randrange(5)}x", "".join(rng.choice("abcÄé") for _ in range(3))])
        text = None if rng.random() < 0.05 else rng.choice([" ", "-", "\n", "7"]).join(word() for _ in range(rng.randrange(30)))
        rows.append((i, text, lang, source, 0))
    return rows + [(900, "lonely terms only once", "xx", "s0", 0), (901, None, "xx", "s1", 0)]


def result(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = result(sd.audit(spark.createDataFrame(rows, DOCS)))
    assert got == brute([(r[2], r[3], r[1]) for r in rows])


def test_tiles_chunks_and_segments(spark, monkeypatch):
    """Small blocks, chunks and segments, and counts passed on early, give the same rows."""
    for name, value in (("CHUNK_BYTES", 400), ("BLOCK", 2), ("SEGMENT", 3), ("HELD", 20)):
        monkeypatch.setattr(sd, name, value)
    rows = corpus(3)
    got = result(sd.audit(spark.createDataFrame(rows, DOCS).repartition(5), most=7))
    assert got == brute([(r[2], r[3], r[1]) for r in rows], most=7)


def test_shares_are_exact():
    for c, total in ((0, 1), (10**9, 3 * 10**9), (2**47, 2**48 - 1), (12345678901, 98765432109876)):
        assert sd.shares(np.array([c], dtype=np.int64), total).tolist() == [1 + 10**9 * (c + 1) // total]


def test_packed_numbers():
    for numbers in ([], [0, 1, 255], [256], [65536, 3], [2**33], [2**62]):
        a = np.array(numbers, dtype=np.int64)
        assert sd.widen(sd.narrow(a)).tolist() == numbers


def test_awkward(spark):
    docs = awkward(spark)
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert result(sd.audit(docs)) == brute(rows)


def test_empty(spark):
    assert sd.audit(spark.createDataFrame([], DOCS)).count() == 0
