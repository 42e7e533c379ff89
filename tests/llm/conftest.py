import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = "word " * 30_000 + "\n" + "tail of a very long text that repeats here\n" * 50
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (None, "A line that is long enough to count\nx", "en", "a", 5),
        (3, "  a LINE that is long enough to count \n\nÄäß other line, also long enough", "de", "b", 5),
        (4, "a line that is long enough to count\r\nshort", "en", "a", 5),
        (4, "a line that is long enough to count\r\nshort", "en", "a", 5),
        (5, long, "en", "a", len(long)),
        (6, "a" * 50_000, "fr", "c", 50_000),
        (7, "12 34 !!", None, "c", 8),
        (8, "\n\n\n", "en", "b", 3),
        (9, "日本語のテキスト \U0001f600 é", "ja", "b", 12),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
