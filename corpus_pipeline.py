"""From raw documents to packed training sequences: quality rules, boilerplate lines, near duplicates, personal data, packing.

Each stage works on all that the one before it kept; all but the last return the columns of ``documents``, and further
columns of the input, whatever their names, go through unchanged. A document that has no words left once boilerplate is
removed goes in that stage.

Defined results: a null or empty text has no words, so the quality rules reject it. A null id is a document like any
other and comes before all others in ties. Rows that repeat an id and a text count one by one for the quality rules, get
the same lines removed, and one of them stays at near duplicates; rows that repeat an id only are documents of their own.
A null source is no site and has no host verdict. Very long texts are processed whole and packed in pieces. An empty
table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import line_dedup, ngram_join, packing, pii, quality_rules
from linkloom.llm.common import WORD, documents, release, settled
from linkloom.llm.queries import vocabulary


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents`` again, ``n_chars`` of the new text."""
    size = F.char_length("text").cast("long")
    return docs.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.cleaned(docs)
    left = found.filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return _measured(left.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs, k=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.mask(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Components, span offsets and tokens are beyond SQL; the tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
