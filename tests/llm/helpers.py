"""Small document tables with the awkward cases that every operator must handle."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, source="src0"):
    rows = [(i, t, "en", source if isinstance(source, str) else source[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Null id, text and site, empty text, a repeated row, a repeated id, ties, a long text, and clashing extra columns."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(6000))
    rows = [
        (None, "a text without an id " * 3, "en", "s0", 9, "x", 1),
        (1, None, None, None, None, None, None),
        (2, "", "en", "s1", 0, "", 0),
        (3, long, "en", "s1", len(long), "y", 2),
        (3, long, "en", "s1", len(long), "y", 2),
        (4, long[: len(long) // 2] + "\n" + "the end", "de", "s2", 3, "z", 3),
        (5, "same text", "en", "s3", 9, "t", 4),
        (5, "another text under the same id", "en", "s3", 9, "t", 4),
        (6, " \n\t\n ", "en", "s3", 5, "t", 4),
        (7, "é" * 300 + "\n" + "日本語のテキスト " * 40, "ja", "s4", 3, "z", 3),
    ]
    return spark.createDataFrame(rows, DOCS + ", rank string, _id long")
