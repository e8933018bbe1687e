"""Batched Jaro and Jaro-Winkler against the plain definition."""

import random

import numpy as np
from pyspark.sql import functions as F

from linkloom.functions import kernels, text


def plain_jaro(a, b, whole=False):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left = [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, f in zip(b, free, strict=True) if not f]
    m, moved = float(len(left)), sum(x != y for x, y in zip(left, right, strict=True))
    return (m / len(a) + m / len(b) + (m - (moved // 2 if whole else moved / 2)) / m) / 3.0


def plain_winkler(a, b, whole=False):
    p = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    j = plain_jaro(a, b, whole)
    return j + p * 0.1 * (1.0 - j)


def names(rng, n, most=14):
    return ["".join(rng.choice("abcdé 日") for _ in range(rng.randrange(most))) for _ in range(n)]


def test_batches(monkeypatch):
    rng = random.Random(1)
    a, b = names(rng, 3000), names(rng, 3000)
    b[:500] = [x[:3] + y for x, y in zip(a, b[:500], strict=False)]
    for cells in (kernels.CELLS, 40):
        monkeypatch.setattr(kernels, "CELLS", cells)
        for whole in (False, True):
            assert kernels.jaro(a, b, whole).tolist() == [plain_jaro(x, y, whole) for x, y in zip(a, b, strict=True)]
            assert kernels.winkler(a, b, whole).tolist() == [plain_winkler(x, y, whole) for x, y in zip(a, b, strict=True)]
    assert kernels.jaro([], []).tolist() == []
    long = "ab" * 3000
    assert kernels.jaro([long, "x"], [long + "c", "y"]).tolist() == [plain_jaro(long, long + "c"), 0.0]


def test_bound_is_never_below():
    rng = random.Random(2)
    a, b = names(rng, 120), names(rng, 120)
    bound = kernels.most_winkler(*kernels.characters(a), *kernels.characters(b))
    exact = np.array([[plain_winkler(x, y) for y in b] for x in a])
    assert (bound >= exact - 1e-12).all()
    assert bound.mean() < 1


def test_columns(spark):
    rows = [("martha", "marhta"), ("dixon", "dicksonx"), (None, "x"), ("x", None), ("", ""), ("martha", "marhta")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(text.jaro(F.col("a"), F.col("b")).alias("j"), text.jaro_winkler(F.col("a"), F.col("b")).alias("w")).collect()
    assert [round(r["j"], 4) if r["j"] is not None else None for r in got] == [0.9444, 0.7667, None, None, 1.0, 0.9444]
    assert [round(r["w"], 4) if r["w"] is not None else None for r in got] == [0.9611, 0.8133, None, None, 1.0, 0.9611]
