"""Personal data by weak supervision (native).

Base kinds (email, ip, card, phone) are matched by pattern and checked (octets, Luhn, number of digits); they always
stay. Further candidates (long tokens, long numbers) are put to three labelers that vote for each: a regex for the exact
shape, a gazetteer of field names in the words before, and the punctuation around. Expectation-maximisation over the
vote patterns (their counts, a table of fixed size) estimates how reliable each labeler is without labels; the
posteriors train a final naive Bayes classifier of spans on the votes, the kind and the length. Spans it gives
``ACCEPT`` or more are added, unless they overlap a base span.

Patterns are written so that matching never backtracks over more than one run of characters and never recurses, and
find what the plain forms beside them find.

Defined results: a null text is empty and has no spans; other nulls do not matter; repeated rows are treated alike; an
empty table gives an empty result (and no model, so nothing is added).
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: Fixed patterns. Plain forms:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+
#: phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?<=[0-9])(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
#: Fixed shapes of secrets and numbers.
SHAPES = {
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})$",
    "number": r"^(?:[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$",
}
#: Fixed gazetteer of field names.
FIELDS = (
    "access account api apikey auth bearer card cc client credential credit debit iban id key passphrase passport passwd password "
    "phone pin private pwd secret session social ssn tel telephone token visa"
).split()
LABELERS = ("shape", "field", "marks")
ACCEPT = 0.9
BEFORE = 40


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: start, end (code points, exclusive) and string of each match, from the pieces around them."""
    p = F.lit(pattern)
    row = lambda s, m: F.struct(s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("m"))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def placed(found: Column) -> Column:
        def walk(pieces: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                s = acc["at"] + F.char_length(F.get(pieces, i))
                m = F.get(found, i)
                return F.struct((s + F.char_length(m)).alias("at"), F.concat(acc["out"], F.array(row(s, m))).alias("out"))

            start = F.struct(F.lit(0).alias("at"), none.alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), walk)).otherwise(none)

    return let(F.regexp_extract_all(text, p, F.lit(0)), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), step) % 10 == 0


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.char_length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _octet)
    size = F.char_length(_digits(m))
    if kind == "card":
        return F.when(size.between(16, 19), _luhn(_digits(m))).otherwise(False)
    return size.between(8, 15)


def _checked(kind: str):
    return lambda x: _valid(kind, x["m"])


def _is(kind: str):
    return lambda x: x["k"] == kind


def _found(text: Column, kind: str) -> Column:
    every = matches(text, PATTERNS[kind])
    if NEEDS[kind]:
        every = F.when(F.contains(text, F.lit(NEEDS[kind])), every).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))
    return every


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (spans of the base kinds, with ``k``) and ``_cand`` (other candidates with their votes)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.withColumn("_raw", F.struct(*[_found(text, k).alias(k) for k in PATTERNS], matches(text, TOKEN).alias("token")))
    named = lambda spans, k: F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    base = F.concat(*[named(F.filter(F.col(f"_raw.{k}"), _checked(k)), k) for k in PATTERNS])
    # a second step, so that the checks above are not repeated for every candidate
    numbers = F.filter(F.col("_raw.card"), lambda x: F.char_length(_digits(x["m"])).between(9, 19))
    tokens = F.filter(F.col("_raw.token"), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))

    def voted(x: Column) -> Column:
        before = F.substr(text, F.greatest(x["s"] - BEFORE, F.lit(0)) + 1, F.least(x["s"], F.lit(BEFORE)))
        after = F.substr(text, x["e"] + 1, F.lit(1))
        shape = F.when(x["k"] == "secret", x["m"].rlike(SHAPES["secret"])).otherwise(x["m"].rlike(SHAPES["number"]))
        field = F.arrays_overlap(F.slice(F.reverse(F.split(F.lower(before), "[^a-z]+")), 1, 4), F.array(*map(F.lit, FIELDS)))
        marks = before.rlike("[=:#]\\s*[\"'(\\[]?$") | (before.rlike("[\"'(\\[]$") & after.isin('"', "'", ")", "]"))
        return F.struct(
            x["k"].alias("k"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            shape.alias("shape"),
            field.alias("field"),
            marks.alias("marks"),
            F.least(F.floor((x["e"] - x["s"]) / 8), F.lit(8)).cast("int").alias("long"),
        )

    free = lambda x: ~F.exists(F.col("_base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    cand = F.filter(F.concat(named(tokens, "secret"), named(numbers, "number")), free)
    return raw.withColumn("_base", base).withColumn("_cand", F.transform(cand, voted)).drop("_raw")


def fit(patterns: list[tuple]) -> list[list]:
    """EM over rows (kind, shape, field, marks, long, count); returns [feature, value, log-odds] of the final classifier.

    Each labeler is right at a rate of its own for either class; rates and the share of true spans are estimated in turn
    with the posterior of each pattern. Then the posteriors, as soft labels, give a naive Bayes classifier its weights.
    """
    if not patterns:
        return []
    prior, hit, false = 0.3, [0.8] * 3, [0.1] * 3
    post = [0.0] * len(patterns)
    for _ in range(200):
        for i, row in enumerate(patterns):
            yes, no = math.log(prior), math.log(1 - prior)
            for vote, h, f in zip(row[1:4], hit, false, strict=True):
                yes += math.log(h if vote else 1 - h)
                no += math.log(f if vote else 1 - f)
            post[i] = 1 / (1 + math.exp(min(no - yes, 700)))
        ones = sum(p * r[5] for p, r in zip(post, patterns, strict=True))
        total = sum(r[5] for r in patterns)
        new = (ones + 1) / (total + 2)
        hit = [(sum(p * r[5] for p, r in zip(post, patterns, strict=True) if r[1 + j]) + 1) / (ones + 2) for j in range(3)]
        false = [(sum((1 - p) * r[5] for p, r in zip(post, patterns, strict=True) if r[1 + j]) + 1) / (total - ones + 2) for j in range(3)]
        done, prior = abs(new - prior) < 1e-9, new
        if done:
            break
    weights = [["prior", "", math.log(prior / (1 - prior))]]
    for f, name in enumerate(("k", *LABELERS, "long")):
        sums: dict = defaultdict(lambda: [1.0, 1.0])
        for p, r in zip(post, patterns, strict=True):
            sums[r[f]][0] += p * r[5]
            sums[r[f]][1] += (1 - p) * r[5]
        yes, no = sum(v[0] for v in sums.values()), sum(v[1] for v in sums.values())
        weights += [[name, v, math.log(a / yes) - math.log(b / no)] for v, (a, b) in sums.items()]
    return weights


def train(rows: DataFrame) -> list[list]:
    """The classifier from rows with ``_cand``; only counts of vote patterns (a few hundred rows at most) reach the driver."""
    c = rows.select(F.explode("_cand").alias("c")).groupBy("c.k", *[f"c.{x}" for x in LABELERS], "c.long").count()
    return fit([tuple(r) for r in c.collect()])


def _accepted(weights: list[list]) -> Column:
    def odds(x: Column) -> Column:
        total = F.lit(0.0)
        for name, value, w in weights:
            total = total + (F.lit(w) if name == "prior" else F.when(x[name] == F.lit(value), w).otherwise(0.0))
        return total >= math.log(ACCEPT / (1 - ACCEPT))

    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return plain(F.filter("_cand", odds)) if weights else F.array().cast("array<struct<k:string,s:int,e:int>>")


def _listed(spans: Column) -> Column:
    """Spans joined as kind:start:end; they come by kind, then start."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = stored(with_candidates(docs.select("doc_id", "text")).select("doc_id", F.transform("_base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))).alias("_base"), "_cand"), "spans")
    counts = [F.size(F.filter("_base", _is(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    listed = _listed(F.concat("_base", _accepted(train(rows))))
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), listed.alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; spans in ``text`` replaced by their kind in angle brackets."""
    found = with_candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"))
    weights = train(found)
    plain = F.transform("_base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    by_start = F.transform(F.concat(plain, _accepted(weights)), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k")))

    def rebuilt(spans: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            gap = F.substr(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
            new = F.struct((-x["e"]).alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), x["k"], F.lit(">")))).alias("out"))
            return F.when(x["s"] >= acc["at"], new).otherwise(acc)

        rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1, F.char_length("text")))
        return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, rest)

    text = F.when(F.size("_base") + F.size("_cand") > 0, let(F.sort_array(by_start), rebuilt)).otherwise(F.col("text"))
    return found.withColumn("_new", text).select(*[F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
