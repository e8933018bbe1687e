import random
import unicodedata

import numpy as np
import pandas as pd

from linkloom import catalog
from linkloom.operators import alignment, blocking, leagues


def test_all_names(spark, tmp_path):
    texts = ["Straße ÆSIR Øre Þór ðæ l'Équipe", "(Köln) a|b x·y «É» don't 日本語 Straße", None, ""]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: r["norm"] for r in catalog.QUERIES["normalize_all_names"](spark, str(tmp_path)).collect()}

    def norm(w):
        folded = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).lower()
        return " ".join("".join(" " if c in "·.-_," else c for c in folded if c not in "'\"").split())

    assert got == {w: norm(w) for t in texts for w in (t or "").split()}


def test_nearest_of_all_labels(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 7) for i in range(300)]
    rows += [(300 + i, rows[i][1], 9) for i in range(0, 100, 10)] + [(400, [0.0] * 4, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in catalog.QUERIES["dense_topk_all"](spark, str(tmp_path)).collect())
    x = {i: np.asarray(v, dtype=np.float32).astype(float) for i, v, _ in rows if any(v)}
    x = {i: v / np.sqrt((v * v).sum()) for i, v in x.items()}
    want = []
    for q in (i for i in x if i % 20 == 0):
        near = sorted((-round(float(x[q] @ v), 5), i) for i, v in x.items() if i != q)[:5]
        want += [(q, rank, i) for rank, (_, i) in enumerate(near, 1)]
    assert got == sorted(want)


def test_queries_call_their_operators(spark, monkeypatch):
    called = []
    for module, name in ((blocking, "top_k"), (leagues, "match_leagues")):
        operator = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _f=operator, _n=name, **b: called.append(_n) or _f(*a, **b))
    folder = "/root/testdata/sf0.001"
    catalog.QUERIES["trigram_topk"](spark, folder)
    catalog.QUERIES["known_map_then_score"](spark, folder)
    assert called == ["top_k", "match_leagues"]


def test_edges_resolved_one_to_one(spark):
    sf_dir = "/root/testdata/sf0.001"
    events = pd.read_parquet(f"{sf_dir}/events.parquet")
    events["at"] = (events["ts"] - pd.Timestamp(0)) // pd.Timedelta(seconds=1)
    side = lambda kind: events.loc[events["event_type"] == kind, ["user_id", "event_id", "at"]]
    pairs = side("click").merge(side("view"), on="user_id", suffixes=("_s", "_t"))
    gap = (pairs["at_s"] - pairs["at_t"]).abs()
    pairs["score"] = np.floor((0.7 + 0.3 * np.exp(-(gap**2) / (2.0 * 3600**2))) * 1000 + 0.5) / 1000
    rows = [(-r.score, str(r.event_id_s), str(r.event_id_t)) for r in pairs[gap <= 21600].itertuples()]
    used, targets, want = set(), set(), set()
    for score, s, t in sorted(rows):
        if s not in used and t not in targets:
            used.add(s)
            targets.add(t)
            want.add((s, t, -score))
    got = [(r["event_id"], r["target_id"], r["score"]) for r in catalog.QUERIES["evidence_greedy"](spark, sf_dir).collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_aligned_events_of_each_user(spark):
    sf_dir = "/root/testdata/sf0.001"
    events = pd.read_parquet(f"{sf_dir}/events.parquet")
    events["at"] = (events["ts"] - pd.Timestamp(0)) // pd.Timedelta(seconds=1)
    want = set()
    for _, own in events.groupby("user_id"):
        s, t = (own[own["event_type"] == kind].assign(k=lambda d: d["event_id"].astype(str)).sort_values(["at", "k"]) for kind in ("click", "signup"))
        name = (s["event_id"].to_numpy()[:, None] * 7 + t["event_id"].to_numpy()[None, :] * 13) % 20 / 20
        ids, others = s["k"].tolist(), t["k"].tolist()
        want |= {(ids[i], others[j]) for i, j in alignment.align(s["at"].to_numpy(), t["at"].to_numpy(), name)}
    got = [(r["s"], r["t"]) for r in catalog.QUERIES["aligned_events"](spark, sf_dir).collect()]
    assert want and set(got) == want and len(got) == len(want)
