import hashlib
import random
import re

import pytest

from linkloom.llm import pii

from .helpers import DOCS, awkward, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def random_texts(seed, n=250):
    rng = random.Random(seed)
    bits = ["a", "B.c", "@", "@x", ".com", ".", "..", "-", " ", "  ", "\n", "+", "+1", "(", ")", "12", "4539578763621486", "4539 5787-6362 1486", "1.2.3.4", "256", "001", "é", "😀", "_", "%", "x@y.z", "5.6", "٣"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def parsed(row):
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in row["spans"].split(",") if x)]


@pytest.mark.parametrize("seed", [1, 2])
def test_base_spans(spark, seed):
    texts = [*random_texts(seed), "a" * 60000, "1" * 60000, "1." * 3000, "a@" + ".b" * 30000, "a@b" + ".b" * 30000 + "..", "+1" + " " * 40000, "1-" * 3000 + "2", None, ""]
    rows = {r["doc_id"]: r for r in pii.find(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want, r = brute(t), rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert set(want) <= set(parsed(r))


def test_votes_add_secrets_and_leave_words(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'some text token = "{h}" goes on' for h in hexes] + [f"a long-word-{i}-with-some-dashes-in-it x" for i in range(200)]
    rows = pii.find(table(spark, texts)).collect()
    for r in rows:
        assert parsed(r) == ([("secret", 19, 59)] if r["doc_id"] < 60 else [])


def test_fit_learns_a_bad_labeler():
    rows = [("secret", a, b, c, 5, n) for a, b, c, n in [(True, True, True, 90), (True, True, False, 95), (False, False, True, 500), (False, False, False, 480)]]
    w = {(f, v): x for f, v, x in pii.fit(rows)}
    assert w["shape", True] > 3 and w["field", True] > 3 and abs(w["marks", True]) < 0.5
    assert pii.fit([]) == []


def test_mask(spark):
    texts = ["mail me@x.org or +1 (555) 555-1234 now", None, "", "é 1.2.3.4", "none"]
    docs = table(spark, texts)
    got = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert got == {0: "mail <email> or <phone> now", 1: None, 2: "", 3: "é <ip>", 4: "none"}
    assert pii.mask(docs).columns == docs.columns


def test_awkward(spark):
    docs = awkward(spark)
    assert pii.find(docs).count() == docs.count() == pii.mask(docs).count()
    assert pii.find(spark.createDataFrame([], DOCS)).count() == 0
