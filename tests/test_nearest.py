"""Exact scans for nearest neighbours, in one tile and in many, against brute force."""

import random

import numpy as np
import pytest

from linkloom.operators import blocking


@pytest.mark.parametrize("sizes", [(2000, 20_000), (4, 9)])
def test_dense_scan(spark, monkeypatch, sizes):
    monkeypatch.setattr(blocking, "QUERIES", sizes[0])
    monkeypatch.setattr(blocking, "ENTITIES", sizes[1])
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3 if i % 10 else 5)], i % 3) for i in range(80)]
    rows += [(80 + i, rows[i][1], rows[i][2]) for i in range(0, 40, 3)] + [(200, [0.0] * 3, 0), (201, [], 0), (202, [1.0], 7)]
    frame = spark.createDataFrame(rows, "id long, x array<float>, label int")
    x = {i: (np.asarray(v, dtype=np.float32).astype(float), b) for i, v, b in rows if np.any(v)}
    unit = {i: (v / np.sqrt((v * v).sum()), b) for i, (v, b) in x.items()}
    for block in ((), ("label",)):
        want = set()
        for q, (v, b) in unit.items():
            if q % 4 == 0:
                near = sorted((-round(float(v @ w), 5), i) for i, (w, c) in unit.items() if i != q and len(w) == len(v) and (not block or b == c))
                want |= {(q, rank, i, -score + 0.0) for rank, (score, i) in enumerate(near[:6], 1)}
        found = blocking.dense_top_k(frame.filter("id % 4 = 0"), frame, 6, block=block)
        got = found.collect()
        assert {(r["query_id"], r["rank"], r["id"], r["score"] + 0.0) for r in got} == want and len(got) == len(want)
        assert found.columns == [*block, "query_id", "id", "score", "rank"]
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert blocking.dense_top_k(frame.limit(0), frame, 3).count() == 0 and blocking.dense_top_k(frame, frame.limit(0), 3).count() == 0


@pytest.mark.parametrize("sizes", [(2000, 20_000), (5, 7)])
def test_sparse_scan(spark, monkeypatch, sizes):
    monkeypatch.setattr(blocking, "QUERIES", sizes[0])
    monkeypatch.setattr(blocking, "ENTITIES", sizes[1])
    rng = random.Random(6)
    names = {f"n{i:02}": (rng.choice("ab"), "".join(rng.choice("xyzé ") for _ in range(rng.randrange(7)))) for i in range(50)}
    rows = [(b, k, t) for k, (b, t) in names.items()]
    e = blocking.encode(spark.createDataFrame(rows, "b string, id string, t string"), "id", "t").join(spark.createDataFrame(rows, "b string, id string, t string").select("b", "id"), "id")
    e = e.select("b", "id", "bucket", "weight")
    vectors: dict = {}
    for r in e.collect():
        vectors.setdefault((r["b"], r["id"]), {})[r["bucket"]] = r["weight"]
    want = set()
    for (b, q), v in vectors.items():
        near = sorted((-round(sum(w * u[g] for g, w in v.items() if g in u), 6), i) for (c, i), u in vectors.items() if b == c and set(u) & set(v))
        want |= {(b, q, rank, i, -score) for rank, (score, i) in enumerate(near[:4], 1)}
    got = blocking.top_k(e.withColumnRenamed("id", "query_id"), e, ["b"], 4, digits=6).collect()
    assert {(r["b"], r["query_id"], r["rank"], r["id"], r["score"]) for r in got} == want and len(got) == len(want)
