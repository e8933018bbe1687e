import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import suffix_tree_lm as lm

from .helpers import DOCS, awkward, table


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def base(rows):
    out_of = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not out_of(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        ws = words(t)
        score = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        out.append((d, out_of(d), len(ws), sum(c[w] > 0 for w in ws), n, round(score, 6)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    passages = [[f"p{i}w{rng.randrange(900)}" for _ in range(50)] for i in range(12)]
    texts = []
    for _ in range(300):
        own = [rng.choice(["The", "of", "and", f"word{int(rng.paretovariate(0.7)) % 3000}"]) for _ in range(rng.randrange(120))]
        texts.append(" ".join(own + (rng.choice(passages) if rng.random() < 0.5 else [])))
    return texts


@pytest.mark.parametrize("tokens_a_bucket", [1_500_000, 2_000])
def test_base_is_exact_and_score_is_better(spark, monkeypatch, tokens_a_bucket):
    monkeypatch.setattr(lm, "TOKENS_A_BUCKET", tokens_a_bucket)
    monkeypatch.setattr(lm, "BATCH", 20_000)
    docs = table(spark, corpus())
    rows = lm.score_documents(docs).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=str)
    assert got == base([(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in rows)


def test_scores_do_not_depend_on_buckets(spark, monkeypatch):
    docs = table(spark, corpus())
    one = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "TOKENS_A_BUCKET", 1_000)
    many = {r["doc_id"]: r["score"] for r in lm.score_documents(docs.repartition(3)).collect()}
    assert all(abs(one[d] - many[d]) < 1e-6 for d in one)


def test_awkward(spark):
    docs = awkward(spark)
    rows = lm.score_documents(docs).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=str)
    assert got == base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert lm.score_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_blocks_keep_words_whole():
    # words that agree in the middle or the lower half of their bits, beside one last word; some have a number
    w2 = np.asarray([7, 7 + (1 << 60), 7 + (1 << 20), 7], dtype=np.uint64)
    w = np.asarray([9, 9, 9 + (1 << 40), 9 + (1 << 50)], dtype=np.uint64)
    w1 = np.full(4, 5, dtype=np.uint64)
    coder = lm.Coder(np.asarray([9, 3, 7 + (1 << 20)], dtype=np.uint64), np.zeros(3), np.zeros(3))
    before, word, doc, _ = lm.read_block(lm.block_of([w1, w2, w2], w, np.arange(4), np.ones(4, dtype=bool), coder), coder)
    assert sorted(zip(*(x.tolist() for x in (*before, word, doc)), strict=True)) == sorted(zip(w1.tolist(), w2.tolist(), w2.tolist(), w.tolist(), range(4), strict=True))


def test_coded_words_are_bounded(spark, monkeypatch):
    counts = spark.createDataFrame([(w, 1, 1 + w * w) for w in range(100)], "w long, c long, n long")
    for most in (0, 7, 60, 1000):
        monkeypatch.setattr(lm, "CODED", most)
        found = lm.frequent_words(counts)
        assert most * 0.5 <= len(found) <= most or len(found) == 100
        assert sorted(found["w"]) == list(range(100 - len(found), 100))


def test_root_counts_are_exact(spark):
    # nothing is kept of a document without words but the chance of its end token, which has no context
    texts = [" ".join(f"w{i * 7 + j}" for j in range(40)) for i in range(200)] + [""] * 37
    rows = [r for r in lm.score_documents(table(spark, texts)).collect() if r["n_tokens"] == 1]
    assert len(rows) == 37 and all(abs(r["score"] - r["base_score"]) < 1e-9 for r in rows)


def scores(rows):
    """Every score of the model, from its definition."""
    out_of = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    docs = [(d, ["<s>", *words(t)]) for d, t in rows]
    uni, after = Counter(), {}
    for d, ws in docs:
        for i in range(1, len(ws)) if not out_of(d) else ():
            uni[ws[i]] += 1
            for k in range(1, min(i, lm.DEPTH) + 1) if i > 1 else ():
                after.setdefault(tuple(ws[i - k : i]), Counter())[ws[i]] += 1
    total = sum(uni.values()) + len(uni) + 1
    chance = {}

    def at(context, w):
        """In use, leave-one-out"""
        if (context, w) in chance:
            return chance[context, w]
        if not context:
            return ((uni[w] + 1) / total,) * 2
        seen = after.get(context, Counter())
        many, kinds = sum(seen.values()), len(seen)

        def loo(x):
            t = kinds - (seen[x] == 1)
            return ((seen[x] - 1) + t * at(context[1:], x)[1]) / max(many - 1 + t, 1)

        if context not in kept:
            gain = sum(n * (math.log(max(loo(x), 1e-300)) - math.log(at(context[1:], x)[1])) for x, n in seen.items())
            kept[context] = gain > lm.MARGIN and many >= 2
        use, parent = at(context[1:], w)
        if kept[context]:
            use, parent = (seen[w] + kinds * use) / (many + kinds), loo(w) if seen[w] else parent
        chance[context, w] = use, parent
        return chance[context, w]

    kept = {}
    return {d: sum(math.log10(at(tuple(ws[max(i - lm.DEPTH, 0) : i]) if i > 1 else (), ws[i])[0]) for i in range(1, len(ws))) for d, ws in docs}


@pytest.mark.parametrize(("tokens_a_bucket", "frequent", "coded"), [(1_500_000, 400_000, 1 << 20), (2_000, 400_000, 10), (2_000, 60, 10), (9_000, 10, 2_000)])
def test_scores_against_definition(spark, monkeypatch, tokens_a_bucket, frequent, coded):
    monkeypatch.setattr(lm, "TOKENS_A_BUCKET", tokens_a_bucket)
    monkeypatch.setattr(lm, "FREQUENT_ROWS", frequent)
    monkeypatch.setattr(lm, "CODED", coded)
    docs = table(spark, corpus() + ["the of the of and the of the"] * 70)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bases = {r["doc_id"]: (round(r["base_score"], 6), r["n_known"]) for r in lm.score_documents(docs).collect()}
    assert bases == {d: (b, k) for d, _, _, k, _, b in base(rows)}
    want = scores(rows)
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in got) < 1e-6


def test_counts_after_frequent_contexts_go_in_blocks(spark, monkeypatch):
    # many frequent contexts, with many different words after each: no operator makes a row of each pair
    monkeypatch.setattr(lm, "FREQUENT_ROWS", 20)
    monkeypatch.setattr(lm, "TOKENS_A_BUCKET", 20_000)
    rng = random.Random(3)
    texts = [" ".join(rng.choice([f"f{rng.randrange(60)}", f"r{rng.randrange(4000)}"]) for _ in range(100)) for _ in range(600)]
    docs = table(spark, texts)
    pairs = len({(a, b) for t in texts for a, b in zip(t.split(), t.split()[1:], strict=False) if a[0] == "f"})
    store = spark._jsparkSession.sharedState().statusStore()
    done = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    assert lm.score_documents(docs).count() == 600
    made = []
    for i in range(store.executionsList().size()):
        if (number := store.executionsList().apply(i).executionId()) in done:
            continue
        nodes, found = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if metric.name() == "number of output rows" and "Join" in node.name() and found.contains(metric.accumulatorId()):
                    made.append((node.name(), int(found.apply(metric.accumulatorId()).replace(",", ""))))
    assert pairs > 10_000 and not [x for x in made if x[1] > pairs / 4]
