import pytest


@pytest.fixture()
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and a column name of our own."""

    def make(extra=(), columns="doc_id long, text string, lang string, source string, n_chars long"):
        rows = [
            (1, "alpha beta gamma", "en", "a", 1),
            (2, "alpha beta gamma", "en", "a", 2),
            (2, "alpha beta gamma", "en", "a", 2),
            (2, "alpha beta gamma", "en", "b", 2),
            (3, "", "en", "a", 0),
            (4, None, None, None, None),
            (None, "alone without an id", "en", "a", 3),
            (None, None, "en", "a", 3),
            (5, "word " * 60_000, "en", "a", 300_000),
            *extra,
        ]
        return spark.createDataFrame(rows, columns)

    return make
