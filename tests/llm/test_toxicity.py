import random
import zlib

import numpy as np
import pandas as pd
import pytest

from linkloom.llm import toxicity as tx

from .helpers import DOCS, awkward

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1, n=900):
    """Prose in which toxic documents have one or two sentences with a bad word; beginnings of words count in half of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "re"]) for _ in range(rng.randrange(1, 4)))
    docs, labels, where = [], [], {}
    for i in range(n):
        sentences = [" ".join(word() for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(3, 9))]
        toxic = rng.random() < 0.25
        if toxic:
            at = rng.randrange(len(sentences))
            bad = rng.choice(["vile", "rotten"]) if i % 2 else "xogg" + word()
            sentences[at] = f"{sentences[at]} {bad} {word()}"
            where[i] = sentences[at]
        docs.append((i, ". ".join(sentences) + ".", "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels, where


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels, where = corpus()
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    return docs, labels, where, tx.judge(frame, known).collect()


def test_held_out_accuracy(judged):
    _, labels, _, rows = judged
    toxic = {i for i, _, y in labels if y}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    said, true = {r["doc_id"] for r in held if r["predicted"]}, {r["doc_id"] for r in held} & toxic
    assert len(said & true) >= 0.9 * len(true)
    assert len(said - true) <= 0.02 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_offending_sentences(judged):
    docs, _, where, rows = judged
    texts = {i: t for i, t, *_ in docs}
    right = total = 0
    for r in rows:
        for span in filter(None, r["offending_spans"].split(",")):
            start, end = map(int, span.split(":"))
            total += 1
            right += texts[r["doc_id"]][start:end].strip() == where.get(r["doc_id"])
    assert total > 100
    assert right >= 0.95 * total


def test_gradient():
    """The gradient is that of the log likelihood of the noisy-or, by differences."""
    pdf = pd.DataFrame({"toxic": [1, 0, 1], "plain": [2, 0, 3], "sizes": [[1, 2], [2], []], "ids": [[0, 0, 1], [1, 2], []]})

    def likelihood(w):
        total = 0.0
        for r in pdf.itertuples():
            at, clean = 0, r.plain * -np.logaddexp(0, w[-1])
            for k in r.sizes:
                clean -= np.logaddexp(0, w[-1] + sum(w[i] for i in r.ids[at : at + k]))
                at += k
            total += np.log(-np.expm1(clean)) if r.toxic else clean
        return total

    w = np.array([0.3, -0.2, 0.7, -1.5])
    steps = np.eye(len(w)) * 1e-6
    assert np.allclose(tx.gradient(w, pdf), [(likelihood(w + d) - likelihood(w - d)) / 2e-6 for d in steps], atol=1e-5)


def test_scores_ignore_other_columns(spark):
    docs, labels, _ = corpus(2, 300)
    known = spark.createDataFrame(labels, LABELS)
    score = lambda rows: [r["score"] for r in sorted(tx.judge(spark.createDataFrame(rows, DOCS), known).collect(), key=lambda r: r["doc_id"])]
    assert score(docs) == score([(i, t, "zz", None, 7) for i, t, *_ in docs])


def test_score_is_the_noisy_or_of_spans(spark):
    model = tx.Model({"<bad>": 8.0, "<wor": 5.0}, -6.0)
    scorer = tx.Scorer(model)
    text = "all is fine. a bad thing! worst of all? bad bad\nend"
    ps = [1 / (1 + np.exp(-scorer.logit(s))) for s in ("all is fine", " a bad thing", " worst of all", " bad bad", "end")]
    assert scorer.document(text) == pytest.approx(1 - np.prod([1 - p for p in ps]))
    assert [text[s["start"] : s["end"]] for s in scorer.spans(text)] == [" a bad thing", " bad bad"]
    assert scorer.document(None) == scorer.document(" .\n") == 0


def test_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (4, 1, None), (5, 1, 1), (5, 1, 0), (None, 1, 1), (77, 0, 1)], LABELS)
    rows = tx.judge(docs, labels).collect()
    assert len(rows) == 10
    assert [r["score"] for r in rows if r["doc_id"] in (1, 2, 6)] == [0, 0, 0]
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    kept = tx.score_documents(docs, tx.Model({"<text>": 9.0}, -5.0))
    assert kept.select("_row.*").columns == docs.columns
    assert sum(r["score"] > 0.5 for r in kept.collect()) == 3


def test_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert tx.judge(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "some text", "en", "s", 0)], DOCS)
    assert [r["score"] for r in tx.judge(some, labels).collect()] == [0.0]
