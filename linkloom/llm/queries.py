"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, line_dedup, ngram_join, packing, periodic_runs, pii, quality_rules, sharding, source_divergence, suffix_dedup, suffix_tree_lm, toxicity
from .common import WORD, documents, let


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op2_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary())


def op3_block_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(documents(spark, sf_dir), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_documents(documents(spark, sf_dir))


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir), 16)


def op6_weak_label_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op8_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary())


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.cleaned(documents(spark, sf_dir))
    return done.select("_row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """``documents`` where every tenth text, by its id's checksum, goes on periodically from some word on. A null id has no checksum."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = (h / 10).cast("long")

    def periodic(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get(words, at(i).cast("int"))), " ")

    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    chosen = (h % 10 == 0) & F.col("text").rlike(WORD)
    return docs.select("doc_id", F.when(chosen, let(words, periodic)).otherwise(F.col("text")).alias("text"))


def op11_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(planted(documents(spark, sf_dir)))


def op12_tiled_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


def op13_sentence_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_paragraph_sketch, op2_exact_packing, op3_block_jaccard, op4_suffix_tree_scores, op5_ring_sharding, op6_weak_label_pii, op7_host_quality, op8_suffix_sort, op9_chunk_bpe, op10_line_spread, op11_harmonic_runs, op12_tiled_divergence, op13_sentence_noisy_or)}

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT rid, i, list_aggregate(words[i : i + 7], 'string_agg', ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         (100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
          OR 100 * n_repeat_words > 10 * n_words OR word_chars > 15 * n_words) AS soft_failed
  FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source
), s AS (
  SELECT avg(k / n) AS mean, greatest(var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n), 0) AS between_v FROM h
), p AS (
  SELECT mean, CASE WHEN between_v > 0 THEN least(greatest(mean * (1 - mean) / between_v - 1, 1), 1e6) ELSE 1e6 END AS weight FROM s
), bad AS (
  SELECT source FROM h, p WHERE (k + mean * weight) / (n + weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (soft_failed AND coalesce(source IN (SELECT source FROM bad), false))) AS kept
FROM f
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), b AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 12
), r AS (
  SELECT k.*, b.key IS NOT NULL AND row_number() OVER (PARTITION BY k.key ORDER BY doc_id, pos) > 1 AS gone
  FROM k LEFT JOIN b ON k.key = b.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS df
  FROM (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL
), t AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(df) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM t GROUP BY lang
), g AS (
  SELECT lang, source, (SELECT coalesce(sum(c.n), 0)::HUGEINT FROM c JOIN t USING (lang, term) WHERE c.lang = o.lang AND c.source = o.source) AS n
  FROM (SELECT DISTINCT lang, source FROM d) o
), p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p,
         1 + (1000000000::HUGEINT * (t.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN t ON t.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""

ORACLES = {"op7_host_quality": OP7_SQL, "op10_line_spread": OP10_SQL, "op12_tiled_divergence": OP12_SQL}
