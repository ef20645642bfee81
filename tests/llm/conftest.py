import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs, with columns that could clash."""

    def make(rows):
        data = [(d, t, "en", "s", 0, "x", 1) for d, t in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words long"
        return spark.createDataFrame(data, kinds)

    return make
