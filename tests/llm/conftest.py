import pytest


@pytest.fixture(scope="module")
def make(spark):
    """A DataFrame of documents from (doc_id, text) pairs, with the other columns and a clashing one."""

    def build(rows, extra=()):
        rows = [(i, t, "en", "src", len(t or ""), "own") for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, row string"
        )

    return build
