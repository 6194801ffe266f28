import pytest

#: Column names that operators use inside; as extra columns they must not matter.
EXTRA = ["k", "th", "w", "h", "n", "s", "pos", "fp", "part", "key", "spans", "found", "ids", "rank", "value", "t", "all", "x"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    long_line = " ".join(f"word{i % 700} and the other thing" for i in range(9000))
    texts = [
        (0, "The quick brown fox jumps over the lazy dog.\nSecond line of it.", "en"),
        (1, None, "en"),
        (2, "", None),
        (3, " \n\t \n", "fr"),
        (4, long_line, "en"),
        (5, "The quick brown fox jumps over the lazy dog.\nSecond line of it.", "en"),
        (5, "The quick brown fox jumps over the lazy dog.\nSecond line of it.", "en"),
        (6, "été à l'école des élèves, où ça mène ? " * 9, "fr"),
        (7, "12345 67890 !!! ???", None),
        (8, "漢字 かな 🎉🎉 x", None),
        (None, "a text without id", "en"),
        (None, None, None),
        (9, "a\x00b\x1c\x85  c  d", "fr"),
    ]
    rows = [(i, t, lang, "src", len(t or ""), *[str(i)] * len(EXTRA)) for i, t, lang in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
