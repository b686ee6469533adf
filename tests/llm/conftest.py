import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(pairs, lang=lambda i: "en"):
        rows = [(i, t, lang(i), "s", None if t is None else len(t), 1, 2, "x") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", row int, score int, spans string").repartition(3)

    return make
