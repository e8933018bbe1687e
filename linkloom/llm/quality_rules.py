"""Host-level quality rules (native).

Every document is measured on its own; the share of documents that fail a rule is then estimated per host, shrunk
towards the corpus by an empirical beta prior, and the verdict on the host is joined back to its documents.

Defined results: a null or empty text has no words and fails (fewer than 20 words). A null host has no verdict: its
documents are judged on their own. Repeated rows are measured and counted one by one. An empty table gives an empty
result. Extra columns are passed through by :func:`filter_documents` and ignored by :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, settled, stored, whole_row

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
#: Shares (in percent) above which a document fails a soft rule; soft failures count for the host, not against the document.
SOFT = {"symbols": 10, "dup_lines": 30, "repeat_words": 10, "long_words": 15}
#: A host whose shrunk failure rate is above this loses the benefit of the doubt: its documents that fail a soft rule go.
MAX_HOST_RATE = 0.5
SALTS = 16


def _repeat_words(words: Column) -> Column:
    """Words inside a window of ``WINDOW`` words that occurs twice or more in the text."""

    def covered(found: Column) -> Column:
        # found: sorted (hash, position); a window repeats when a neighbour has its hash
        size = F.size(found)
        at = lambda i: F.get(found, i)
        twice = F.filter(
            F.transform(found, lambda x, i: F.when((at(i - 1)["h"] == x["h"]) | (at(i + 1)["h"] == x["h"]), x["p"])),
            lambda p: p.isNotNull(),
        )
        gaps = lambda ps: F.aggregate(
            F.transform(ps, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0),
            lambda a, x: a + x,
        )
        return F.when(size > 0, let(F.sort_array(twice), gaps)).otherwise(0)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def repeats(wins: Column) -> Column:
        indexed = F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(wins)) < F.size(wins), let(F.sort_array(indexed), covered)).otherwise(0)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = let(hashes, lambda hs: let(windows(hs), repeats))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with one struct column ``_m``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dense = F.translate(text, SPACES, "")
    plain = F.translate(text, SYMBOLS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def shaped(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(dense).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(plain)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    return docs.withColumn("_m", let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), shaped))


def _base_failed() -> Column:
    return (F.col("_m.n_words") < MIN_WORDS) | (100 * F.col("_m.n_repeat_words") > 30 * F.col("_m.n_words"))


def _soft_failed() -> Column:
    m = lambda c: F.col(f"_m.{c}")
    return (
        (100 * m("n_symbols") > SOFT["symbols"] * m("word_chars"))
        | (100 * m("lines.dup") > SOFT["dup_lines"] * m("lines.n"))
        | (100 * m("n_repeat_words") > SOFT["repeat_words"] * m("n_words"))
        | (m("word_chars") > SOFT["long_words"] * m("n_words"))
    )


def host_rates(flags: DataFrame) -> DataFrame:
    """One row per host from rows (host, failed): n_docs, n_failed, rate (shrunk), bad_host.

    The beta prior is fitted by moments over hosts: its mean is the hosts' mean failure rate, and its weight (the number
    of documents it counts for) is what their spread leaves after binomial noise, between 1 and a million.
    """
    hosts = stored(
        flags.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")),
        "hosts",
    )
    p = F.col("n_failed") / F.col("n_docs")
    s = hosts.agg(F.avg(p).alias("m"), F.var_pop(p).alias("v"), F.avg(1 / F.col("n_docs")).alias("i")).first()
    mean = s["m"] if s["m"] is not None else 0.5
    noise = mean * (1 - mean)
    between = max((s["v"] or 0.0) - noise * (s["i"] or 0.0), 0.0)
    weight = min(max(noise / between - 1 if between > 0 else 1e6, 1.0), 1e6)
    rate = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("rate", rate).withColumn("bad_host", F.col("rate") > MAX_HOST_RATE)


def _with_verdict(measured: DataFrame, hosts: DataFrame) -> DataFrame:
    """``measured`` (host, base_failed, soft_failed, ...) with ``kept``. A large host is spread over SALTS join keys."""
    bad = hosts.filter("bad_host").select(F.col("host").alias("_bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_bad_salt"))
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(bad, (F.col("host") == F.col("_bad")) & (F.col("_salt") == F.col("_bad_salt")), "left")
    kept = ~F.col("base_failed") & ~(F.col("_bad").isNotNull() & F.col("soft_failed"))
    return joined.withColumn("kept", kept).drop("_bad", "_bad_salt", "_salt")


def _flags(measured: DataFrame, *kept: Column) -> DataFrame:
    return measured.select(*kept, _base_failed().alias("base_failed"), _soft_failed().alias("soft_failed"))


def _rates_of(flags: DataFrame) -> DataFrame:
    return host_rates(flags.select("host", (F.col("base_failed") | F.col("soft_failed")).alias("failed")))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: doc_id, the measures, base_failed and kept."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    at = ("n_words", "word_chars", "n_symbols", "lines.dup", "n_repeat_words")
    measured = measure(docs.select("doc_id", "text", F.col(host).alias("host")))
    rows = stored(_flags(measured, F.col("doc_id"), F.col("host"), *[F.col(f"_m.{a}").alias(n) for a, n in zip(at, names, strict=True)]), "quality")
    return _with_verdict(rows, _rates_of(rows)).select("doc_id", *names, "base_failed", "kept")


def filter_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rows = docs.select(whole_row(docs).alias("_row"), "doc_id", "text", F.col(host).alias("host"))
    flags = _flags(measure(rows), F.col("_row"), F.col("doc_id"), F.col("host"))
    # measuring twice costs less than a second copy of the corpus on the shared disk
    return _with_verdict(flags, settled(lambda: _rates_of(flags.drop("_row")), "rates")).filter("kept").select("_row.*")
