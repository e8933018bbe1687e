import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from linkloom.llm import line_dedup, quality_rules, sharding

from .helpers import DOCS, awkward, table


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def measures(t):
    t = t or ""
    w = words(t)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    repeat = len({j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)})
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat


def texts():
    rng = random.Random(6)
    out = ["", None, " \n\t ", "a\n\na\nb\na", "x " * 30, "é|ß " * 25]
    for _ in range(80):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        out.append(" ".join(w + w[: rng.randrange(len(w) + 1)]) + rng.choice(["", "\n#line", "\nline\nline"]))
    return out


def test_quality_measures(spark):
    ts = texts()
    rows = {r["doc_id"]: r for r in quality_rules.judge(table(spark, ts)).collect()}
    for i, t in enumerate(ts):
        r, m = rows[i], measures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r["kept"] and r["base_failed"])


def test_bad_hosts_lose_the_benefit_of_the_doubt(spark):
    good = " ".join(f"word{i}" for i in range(40))
    soft = " ".join(f"w{i}#" for i in range(40))
    ts = [soft] * 40 + [good] * 10 + [good] * 60 + [soft] * 2
    hosts = ["bad"] * 50 + ["fine"] * 62
    kept = Counter()
    for r in quality_rules.judge(table(spark, ts, hosts)).collect():
        kept[hosts[r["doc_id"]], ts[r["doc_id"]] == soft] += r["kept"]
    assert kept == Counter({("bad", True): 0, ("bad", False): 10, ("fine", False): 60, ("fine", True): 2})


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rng = random.Random(seed)
    pool = ["All rights reserved.", " Cookie notice ", "", "shared by few", "x"]
    ts = ["\n".join(rng.choice([*pool, f"own line {i} {j}"]) for j in range(rng.randrange(1, 8))) for i in range(150)]
    sites = [f"s{rng.randrange(14)}" if rng.random() < 0.95 else None for _ in ts]
    where, first = defaultdict(set), {}
    for i, t in enumerate(ts):
        for j, x in enumerate(t.split("\n")):
            if words(x):
                if sites[i]:
                    where[x.strip()].add(sites[i])
                first.setdefault(x.strip(), (i, j))
    for least in (6, 12):
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.clean(table(spark, ts, sites), least).collect()}
        for i, t in enumerate(ts):
            lines = t.split("\n")
            kept = [x for j, x in enumerate(lines) if len(where[x.strip()]) < least or first[x.strip()] == (i, j)]
            assert got[i] == ("\n".join(kept), len(lines), len(lines) - len(kept))


@pytest.mark.parametrize("n", [0, 1, 17, 400])
def test_shards(spark, n):
    rng = random.Random(n)
    ts = ["hot copy" if rng.random() < 0.4 else f"text {i}" for i in range(n)]
    rows = sharding.place(table(spark, ts), 16).collect()
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        t = ts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t.encode()), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_ring_moves_little():
    rng = random.Random(3)
    counts = Counter(rng.randrange(sharding.CELLS) for _ in range(20000))
    place = lambda k: {c: [s for _, a, b, s, _ in g for _ in range(b - a)] for c, g in by_cell(sharding.allocate(counts, k)).items()}

    def by_cell(rows):
        out = defaultdict(list)
        for r in rows:
            out[r[0]].append(r)
        return out

    a, b = place(16), place(17)
    moved = sum(x != y for c in a for x, y in zip(a[c], b[c], strict=True))
    assert moved < 0.6 * 20000


def test_awkward(spark):
    docs = awkward(spark)
    assert quality_rules.judge(docs).count() == line_dedup.clean(docs).count() == sharding.place(docs).count() == docs.count()
    assert line_dedup.clean(docs).columns[-2:] == ["n_lines", "n_removed"] and quality_rules.filter_documents(docs).columns == docs.columns
    none = spark.createDataFrame([], DOCS)
    assert quality_rules.judge(none).count() == line_dedup.clean(none).count() == quality_rules.filter_documents(none).count() == 0
