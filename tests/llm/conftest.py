import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) pairs."""

    def make(rows, schema=DOCS):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """NULL ids and texts, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "One"),
        (5, "oNE"),
        (5, "oNE"),
        (6, long),
        (7, long.upper()),
        (None, "no id here"),
        (None, None),
        (8, "É é ß line\n\nline\r\n"),
        (9, "same words in a row " * 40),
    ]
