import random
import re

import numpy as np
import pytest

from linkloom.llm import ngram_join as nj
from linkloom.llm.shingles import shingle_sets

from .helpers import DOCS, awkward, table


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(ids, texts, k, num, den):
    sets = brute_sets(texts, k)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, d in enumerate(ids)), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and out:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 2)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        elif kind < 0.65:
            out.append(" ".join(passage + [rng.choice(words) for _ in range(rng.randrange(1, 40))]))
        elif kind < 0.75:
            out.append(" ".join(rng.choice(words[:3]) for _ in range(rng.randrange(0, 25))))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))))
    return out


def test_shingles():
    ts = corpus(1) + ["", " ", "One", "ONE two", "Ü a B", "a\x0bb\x0cc d", "x" * 70000 + " b c"]
    for k in (3, 5):
        assert [len(s) for s in shingle_sets(ts, k)] == [len(s) for s in brute_sets(ts, k)]


@pytest.mark.parametrize(("num", "k"), [(90, 3), (80, 5)])
def test_similar_sets_share_a_block(num, k):
    ts = [t for seed in range(6) for t in corpus(seed)]
    sets = shingle_sets(ts, k)
    keys = [dict(zip(x.tolist(), c.tolist(), strict=True)) for x, c in zip(*nj.block_keys(sets, num, 100), strict=True)]
    exact = brute_sets(ts, k)
    links = 0
    for i in range(len(ts)):
        for j in range(i):
            a, b = exact[i], exact[j]
            link = bool(a) and bool(b) and 100 * len(a & b) >= num * len(a | b)
            if a and b:
                bound = nj.room(nj.profile(sets[i]), nj.profile(sets[j])).sum()
                assert len(a & b) <= bound <= min(len(a), len(b))
                assert link == (len(a & b) >= nj.needed(len(a), len(b), num, 100))
            if link and a != b:
                links += 1
                both = keys[i].keys() & keys[j].keys()
                # in one class at least, both share as many keys as their codes say
                assert any(sum(keys[i][y] == code for y in both) >= code >> 1 for code in set(keys[i].values()))
                assert any(sum(keys[j][y] == code for y in both) >= code >> 1 for code in set(keys[j].values()))
    assert links > 100


def test_short_of_full_blocks():
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(5, 40), dtype=np.uint64)
        a, b = np.unique(base), np.unique(np.append(base[: len(base) - len(base) // 12], rng.integers(0, 2**63, 1, dtype=np.uint64)))
        if len(np.intersect1d(a, b)) >= nj.needed(len(a), len(b), 80, 100):
            (x, y), _ = nj.block_keys([a, b], 80, 100)
            assert set(x.tolist()) & set(y.tolist())


@pytest.mark.parametrize(("seed", "num", "k"), [(3, 90, 3), (4, 80, 5)])
def test_components(spark, seed, num, k):
    ts = corpus(seed) + ["", None, "tie tie tie", "tie tie tie"]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.near_duplicates(table(spark, ts), k, num, 100).collect()), key=str)
    assert got == brute(range(len(ts)), ts, k, num, 100)


def test_blocks_that_are_empty_beyond_the_spared_ones():
    # n-grams that all fall into a few blocks: two such documents still share a key
    rng = np.random.Generator(np.random.PCG64(2))
    pool = rng.integers(0, 2**63, 40_000, dtype=np.uint64)
    n, spare = nj.blocks(nj.size_class(60), 80, 100)
    few = pool[nj.mix(pool, 1) % np.uint64(n) < 3][:60]
    a, b = np.unique(few), np.unique(np.append(few[:-4], pool[:2]))
    assert n - 3 > spare and len(a) == 60
    (x, y), _ = nj.block_keys([a, b], 80, 100)
    assert set(x.tolist()) & set(y.tolist()) and len(x) < 60


def test_hot_blocks_and_tiles(spark, monkeypatch):
    """A group of near copies so large that its blocks are salted and its hub is cut into tiles."""
    from linkloom.llm import common

    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    ts = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"own{i}"
        ts.append(" ".join(w))
    ts += corpus(12, 60)
    monkeypatch.setattr(nj, "SAMPLE", 1)
    monkeypatch.setattr(nj, "SALTS", 3)
    monkeypatch.setattr(nj, "TILE", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.near_duplicates(table(spark, ts), 3, 90, 100).collect()), key=str)
    assert got == brute(range(len(ts)), ts, 3, 90, 100)


def test_awkward(spark):
    docs = awkward(spark)
    rows = docs.collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.near_duplicates(docs).collect()), key=str)
    assert got == brute([r["doc_id"] for r in rows], [r["text"] for r in rows], 5, 80, 100)
    assert nj.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_first_with_one_repeated_id(spark):
    """One unrelated repeated id changes nothing for the other documents: the smallest id of each group stays."""
    rng = random.Random(9)
    pair = lambda i: [rng.choice([f"w{i}x{j}" for j in range(300)]) for _ in range(200)]
    texts = []
    for i in range(12):
        w = pair(i)
        texts += [" ".join(w), " ".join(w[:-1] + ["other"])]
    docs = table(spark, texts)
    want = list(range(0, 24, 2))
    assert sorted(r["doc_id"] for r in nj.keep_first(docs).collect()) == want
    more = spark.createDataFrame([(90, "one text of a repeated id", "en", "s", 1), (90, "and quite another text", "en", "s", 1)], DOCS)
    assert sorted(r["doc_id"] for r in nj.keep_first(docs.unionByName(more)).collect()) == [*want, 90, 90]
