import hashlib
import random
from collections import Counter

import numpy as np

from linkloom.llm import fingerprints as fp

from .helpers import DOCS, awkward, table


def brute_likeness(a, b):
    def bag(t):
        return Counter(fp.paragraphs(t))

    x, y = bag(a), bag(b)
    size = lambda c: sum(len(k) * v for k, v in c.items())
    shared = size(x & y)
    return shared / (size(x) + size(y) - shared) if x or y else 1.0


def texts(n=60, seed=3):
    rng = random.Random(seed)
    out = ["", "", "one", "a b c. a b c. a b c. ", "x" * 5000]
    for _ in range(n):
        out.append("".join(rng.choice(["Alpha beta. ", "gamma! ", "delta\n", "eps zeta eta theta " * 9]) for _ in range(rng.randrange(200))))
    return out


def test_paragraphs_are_the_text():
    for t in texts():
        assert "".join(fp.paragraphs(t)) == t


def test_likeness_is_exact():
    ts = texts()
    pairs = np.asarray([(i, (i * 7 + 1) % len(ts)) for i in range(len(ts))] + [(i, i) for i in range(len(ts))])
    got = fp.likeness(pairs, *fp.digests(ts), len(ts))
    for (i, j), g in zip(pairs, got, strict=True):
        assert abs(g - brute_likeness(ts[i], ts[j])) < 1e-9


def expect(docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        e = fp.edited(t, after)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(brute_likeness(t, e), 9), round(brute_likeness(t, after), 9)))
    return sorted(out, key=str)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(fp, "DOCS_PER_RUN", 7)
    sparse = table(spark, texts()).selectExpr("if(doc_id < 30, doc_id, doc_id * doc_id * 1000003 - 5000000000) as doc_id", "text")
    for docs in (awkward(spark), sparse, table(spark, texts()), table(spark, ["only"]), spark.createDataFrame([], DOCS)):
        rows = fp.fingerprint_documents(docs).collect()
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows]
        assert sorted(got, key=str) == expect(docs)


def test_equal_texts_have_equal_fingerprints(spark):
    rows = fp.fingerprint_documents(table(spark, ["a b. c", "other", "a b. c", ""])).collect()
    by = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert by[0] == by[2] != by[1]
