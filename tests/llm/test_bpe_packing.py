import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from linkloom.llm import bpe, packing  # noqa: E402

from .helpers import DOCS, awkward, table  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a\x1cb c", "x\x85y　z w", "é ́e", "A<|endoftext|>B <|startoftext|>", "İstanbul ΣΑΣ ß", "don't I'LL 12345 !!??", "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "x" * 20000, " ", "\n\n\t", "á" * 3000 + " b"]


def texts():
    rng = random.Random(5)
    shared = " ".join(f"shared{rng.randrange(50)}," for _ in range(900))
    out = list(ODD)
    for _ in range(20):
        own = " ".join(rng.choice(["Foo", "bar's", "béta", "12.5", "日本", "x́y"]) + str(rng.randrange(99)) for _ in range(rng.randrange(600)))
        out += [own + " " + shared + own, own + shared]
    return out


def test_ids_and_decoding_are_the_library_s():
    t, c = Tokenizer.from_file(PATH), bpe.ChunkCodec(PATH)
    all_texts = texts()
    for found, text in zip(c.encode(all_texts), all_texts, strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert found == np.asarray(want, dtype="<u4").tobytes()
        assert c.words.decode(found) == t.decode(want, skip_special_tokens=False)
    assert c.reused > 50
    assert c.words.encode(all_texts) == c.encode(all_texts)


def test_chunks_are_cut_by_content():
    a = " ".join(map(str, range(4000)))
    shifted = bpe.cuts("some words before it " + a)
    assert len({len(a) - x for x in bpe.cuts(a)} & {len(a) + 21 - x for x in shifted}) >= len(shifted) - 2


def test_encode_documents(spark):
    t = Tokenizer.from_file(PATH)
    docs = awkward(spark)
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, PATH).collect())
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patterns_cover_counts(seed):
    rng = random.Random(seed)
    cap = 64
    counts = Counter(rng.choice([rng.randrange(1, 65), rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 3000)))
    found = packing.patterns(dict(counts), cap)
    back = Counter()
    for pattern, times in found:
        assert sum(pattern) <= cap
        for x in pattern:
            back[x] += times
    assert back == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in found) <= -(-total // cap) + 2
    assert packing.patterns({}, cap) == []


def test_pack_documents(spark):
    t = Tokenizer.from_file(PATH)
    docs = awkward(spark).unionByName(table(spark, ["tie"] * 300 + ["another " * 5000]).selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars", "'' as rank", "0L as _id"))
    rows = packing.pack_documents(docs, PATH, 1000).collect()
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 1000):
            p = ids[s : s + 1000]
            want[r["doc_id"], s // 1000, s, len(p), zlib.crc32(np.asarray(p, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1000
    assert len(by) <= -(-sum(r["length"] for r in rows) // 1000) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_a_join_that_never_agrees_is_encoded_whole(monkeypatch):
    t, c = Tokenizer.from_file(PATH), bpe.ChunkCodec(PATH)
    all_texts = texts()
    repair = bpe.ChunkCodec._repair
    monkeypatch.setattr(bpe.ChunkCodec, "_repair", lambda self, joins: [None if i % 3 == 0 else x for i, x in enumerate(repair(self, joins))])
    for found, text in zip(c.encode(all_texts), all_texts, strict=True):
        assert found == np.asarray(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
