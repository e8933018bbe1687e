import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402

from linkloom.llm.queries import vocabulary  # noqa: E402

from .helpers import DOCS, awkward  # noqa: E402
from .test_ngram_join import brute as brute_components  # noqa: E402
from .test_pii import brute as brute_spans  # noqa: E402


def documents(spark, tmp_path):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    footer, rows = "All rights reserved by the site.", []
    for i in range(160):
        kind, site = i % 8, f"s{i % 16}"
        text = "\n".join(line(rng.randrange(5, 20)) for _ in range(rng.randrange(3, 9)))
        if kind == 1 and i > 16:
            w = rows[i - 9][1].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif kind == 2:
            text = "too short"
        elif kind == 3:
            text += "\nwrite to some.one@mail.example.com or +1 (555) 555-1234"
        elif kind == 4:
            text = line(9) + " " + " ".join(["again and again we say the same words"] * 12)
        elif kind == 5:
            text = footer + "\n" + footer
        if kind in (0, 3, 5, 6):
            text += "\n" + footer
        rows.append((i, text, "en", site, len(text)))
    rows.append((160, None, "en", None, None))
    rows.append((161, "", None, "s1", 0))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows):
    """The documents that are left before packing, and their texts."""

    def repeated(w):
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(win)
        return len({j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)})

    rows = [r for r in rows if len(words(r[1])) >= 20 and 100 * repeated(words(r[1])) <= 30 * len(words(r[1]))]
    sites, first = defaultdict(set), {}
    for d, t, _, s, _ in rows:
        for i, x in enumerate(t.split("\n")):
            if words(x):
                sites[x.strip()].add(s)
                first.setdefault(x.strip(), (d, i))
    kept = []
    for d, t, *_ in rows:
        now = "\n".join(x for i, x in enumerate(t.split("\n")) if len(sites.get(x.strip(), ())) < 12 or first[x.strip()] == (d, i))
        if now == t or words(now):
            kept.append((d, now))
    groups = brute_components([d for d, _ in kept], [t for _, t in kept], 5, 80, 100)
    lowest = {c for _, _, c in groups}
    out = {}
    for d, t in kept:
        if d in lowest:
            for k, s, e in sorted(brute_spans(t), key=lambda x: -x[1]):
                t = f"{t[:s]}<{k}>{t[e:]}"
            out[d] = t
    return out


def test_stages(spark, tmp_path):
    rows = documents(spark, tmp_path)
    want = brute(rows)
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append(docs.count())
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert sorted(left, reverse=True) == left and left[-1] < left[0] < len(rows)
    pieces = cp.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    assert sum(r["length"] for r in pieces) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in want.values())
    assert {r["doc_id"] for r in pieces} == set(want)


def test_awkward(spark, tmp_path):
    for name, rows in (("some", awkward(spark)), ("none", spark.createDataFrame([], DOCS))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
    pieces = cp.run(spark, str(tmp_path / "some")).collect()
    # the long text and its first half stay, of the repeated row one; the other texts are short or repeat themselves
    assert {r["doc_id"] for r in pieces} == {3, 4}
    assert len({(r["doc_id"], r["start"]) for r in pieces}) == len(pieces)
    assert all(r["length"] > 0 for r in pieces)


def test_two_runs_side_by_side(spark, tmp_path):
    documents(spark, tmp_path)
    first = cp.run(spark, str(tmp_path))
    second = cp.run(spark, str(tmp_path))
    one, two = ({(r["doc_id"], r["piece"], r["ids_crc32"]) for r in x.collect()} for x in (first, second))
    assert one == two and one
