import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text) rows, with extra columns that clash with internal names."""

    def build(rows, extra=True):
        schema = DOC + (", n_words long, sid long, _doc long, _row string, rank string, block string" if extra else "")
        return spark.createDataFrame([(i, t, None, None, None) + ((7, 8, 9, "x", None, "b") if extra else ()) for i, t in rows], schema)

    return build
