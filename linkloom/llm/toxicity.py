"""Toxicity of documents by multiple-instance learning: only documents carry labels, sentences carry the scores.

A sentence's score is a logistic function of what its words look like (whole words, their beginnings and endings); a
document is toxic unless every one of its sentences is clean, so its score is the noisy-or of its sentences'. The weights
maximise the likelihood of the document labels under that rule, which tells by itself which sentences are to blame: once
a document is explained by one sentence, the others gain nothing from it. The sentences above one half are returned as
spans.

The model is fitted on a bounded sample of the labelled training documents (``MOST`` documents, chosen by a hash of their
ids; equal texts count once) with at most ``FEATURES`` features, those whose document counts differ most between the
labels. Counting, gradients and scores are made where the rows are; the driver holds the weights and adds up one
gradient a task. Scoring reads every text whole and shuffles nothing. Labels, lang, source and doc_id are never inputs.

Defined results: a null or empty text has no sentence and score 0; labels with a null doc_id or value are left out, of
several labels of a document the largest counts; without a toxic training document every score is 0; a null id is never
labelled and not held out; rows that repeat are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import release, stored, whole_row

#: Training documents that the model is fitted on, about.
MOST = 20_000
#: Features of the model at most, and the least likelihood ratio (G squared) and toxic documents of each.
FEATURES = 4096
LEAST_RATIO = 15.0
LEAST_DOCS = 3
#: Lengths of the beginnings and endings of words.
AFFIXES = range(3, 7)
STEPS = 40
RATE = 0.3
L2 = 1.0
#: The bias stays below this, so that a sentence without any sign is clean.
TOP_BIAS = -3.0
TOXIC = 0.7
OFFENDING = 0.5
#: Words whose weight a worker remembers.
REMEMBERED = 300_000

_BREAK = re.compile(r"[.!?\n。！？]+")
_SENTENCE = re.compile(r"[^.!?\n。！？]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def features(token: str) -> set[str]:
    """The words in a token, their beginnings (``<abc``) and endings (``abc>``)."""
    out = set()
    for word in _WORD.findall(token.lower()):
        out.add(f"<{word}>")
        for k in AFFIXES:
            if len(word) > k:
                out.add("<" + word[:k])
                out.add(word[-k:] + ">")
    return out


class Remembered(dict):
    """Values of tokens, made once and remembered while there are not too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = value = self.make(token)
        return value


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """(text, toxic) of about ``most`` labelled documents that are not held out, equal texts once."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = stored(known, "labels")
    share = int(2**20 * min(1.0, most / max(known.count(), 1)))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < share)  # about ``most`` rows, whatever the table
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")
    release(known)
    return sample


def telling_features(sample: DataFrame, most: int = FEATURES) -> list[str]:
    """The features that toxic documents have more often, by the G statistic of their document counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = Remembered(features), (Counter(), Counter())
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                counts[toxic > 0].update(set().union(*map(known.__getitem__, set(text.split()))))
        clean, bad = counts
        names = iter(clean.keys() | bad.keys())
        while part := list(islice(names, 50_000)):
            yield pd.DataFrame({"feature": part, "bad": [bad[f] for f in part], "clean": [clean[f] for f in part]})

    total = sample.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    n1, n0 = total["bad"] or 0, total["clean"] or 0
    if not n1 or not n0:
        return []
    counted = sample.mapInPandas(run, "feature string, bad long, clean long").groupBy("feature").agg(F.sum("bad").alias("a"), F.sum("clean").alias("b"))
    counted = counted.filter((F.col("a") >= LEAST_DOCS) & (F.col("a") * n0 > F.col("b") * n1))
    term = lambda k, n, p: F.when(k > 0, k * F.log(p)).otherwise(0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0)
    a, b, p = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / (n1 + n0)
    ratio = 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, p) - term(b, n0, p))
    best = counted.withColumn("ratio", ratio).filter(F.col("ratio") > LEAST_RATIO).orderBy(F.round("ratio", 6).desc(), "feature").limit(most)
    return [r["feature"] for r in best.select("feature").collect()]


def _bags(sample: DataFrame, index: dict[str, int]) -> DataFrame:
    """(toxic, plain, sizes, ids): the features of each sentence that has any, and how many sentences have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Remembered(lambda token: {index[f] for f in features(token) if f in index})
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                plain, sizes, ids = 0, [], []
                for sentence in _BREAK.split(text):
                    found = set().union(*map(known.__getitem__, tokens)) if (tokens := set(sentence.split())) else None
                    if found:
                        sizes.append(len(found))
                        ids += sorted(found)
                    elif found is not None:
                        plain += 1
                out.append((toxic, plain, sizes, ids))
            yield pd.DataFrame(out, columns=["toxic", "plain", "sizes", "ids"])

    return sample.mapInPandas(run, "toxic int, plain long, sizes array<int>, ids array<int>")


def gradient(weights: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
    """What the documents of ``pdf`` add to the gradient of the log likelihood, the bias last."""
    w, bias = weights[:-1], weights[-1]
    sizes = np.concatenate([*pdf["sizes"], np.zeros(0, dtype=np.int64)]).astype(np.int64)
    ids = np.concatenate([*pdf["ids"], np.zeros(0, dtype=np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["sizes"]])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    plain, toxic = pdf["plain"].to_numpy(), pdf["toxic"].to_numpy() > 0
    z = bias + np.bincount(sentence, w[ids], minlength=len(sizes))
    clean = np.bincount(doc, -np.logaddexp(0, z), minlength=len(pdf)) - plain * np.logaddexp(0, bias)
    p = np.clip(-np.expm1(clean), 1e-9, 1)
    factor = np.where(toxic, (1 - p) / p, -1.0)
    by_sentence = factor[doc] / (1 + np.exp(-z))
    own = np.bincount(ids, by_sentence[sentence], minlength=len(w))
    return np.append(own, by_sentence.sum() + (factor * plain).sum() / (1 + np.exp(-bias)))


def fit(sample: DataFrame, steps: int = STEPS) -> Model:
    """The weights of the telling features that maximise the penalised likelihood, by gradient steps of adapted size."""
    names = telling_features(sample)
    if not names:
        return Model({}, -np.inf)
    bags = stored(_bags(sample, {f: i for i, f in enumerate(names)}), "bags")
    w, mean, square = np.append(np.zeros(len(names)), -5.0), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):

        def run(batches: Iterator[pd.DataFrame], w=w) -> Iterator[pd.DataFrame]:
            total = sum((gradient(w, pdf) for pdf in batches), np.zeros(len(w)))
            yield pd.DataFrame({"g": [total.tobytes()]})

        g = sum(np.frombuffer(r["g"]) for r in bags.mapInPandas(run, "g binary").collect()) - np.append(L2 * w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w[-1] = min(w[-1], TOP_BIAS)
    release(bags)
    return Model(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]))


class Scorer:
    """Scores of sentences and documents under a model, in one worker."""

    def __init__(self, model: Model):
        get = model.weights.get
        self.bias = model.bias
        self.plain = -np.logaddexp(0, model.bias)
        self.weight = Remembered(lambda token: sum(get(f, 0.0) for f in features(token)))

    def logit(self, sentence: str) -> float:
        return self.bias + sum(map(self.weight.__getitem__, set(sentence.split())))

    def document(self, text: str | None) -> float:
        clean, plain, weight = 0.0, 0, self.weight.__getitem__
        for sentence in _BREAK.split(text or ""):
            if tokens := set(sentence.split()):
                if own := sum(map(weight, tokens)):
                    clean -= np.logaddexp(0, self.bias + own)
                else:
                    plain += 1
        return float(-np.expm1(clean + (plain * self.plain if plain else 0.0)))

    def spans(self, text: str | None, least: float = OFFENDING) -> list[dict]:
        """The sentences that score ``least`` or more, by code points, the end exclusive."""
        out = []
        for m in _SENTENCE.finditer(text or ""):
            p = float(1 / (1 + np.exp(-self.logit(m.group())))) if m.group().split() else 0.0
            if p >= least:
                out.append({"start": m.start(), "end": m.end(), "score": p})
        return out


SCORED = "score double, offending array<struct<start: bigint, end: bigint, score: double>>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``_row`` (all columns of the input), score and the offending sentences of each document."""
    rows = docs.select(whole_row(docs).alias("_row"), F.col("text").cast("string").alias("text"))
    kind = StructType([rows.schema["_row"], *StructType.fromDDL(SCORED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        each = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = [scorer.document(t) for t in texts]
            # a sentence over one half makes its document so
            spans = [scorer.spans(t) if s >= OFFENDING else [] for s, t in zip(scores, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(scores, pa.float64()), pa.array(spans, each)], names=kind.names)

    return rows.mapInArrow(run, kind)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out and score all documents: doc_id, held_out, score, predicted, and the
    offending sentences' number and spans."""
    sample = training_sample(docs, labels)
    model = fit(sample)
    release(sample)
    found = score_documents(docs.select("doc_id", "text"), model).select("_row.doc_id", "score", "offending")
    spans = F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
        F.array_join(spans, ",").alias("offending_spans"),
    )
