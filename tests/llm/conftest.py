import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, twin string"


@pytest.fixture
def make_docs(spark):
    """Documents from {id: text} or [(id, text)], with columns whose names clash with those of operators."""

    def make(texts):
        rows = list(texts.items()) if isinstance(texts, dict) else list(texts)
        return spark.createDataFrame([(i, t, "en", None, len(t or ""), 1.5, "x") for i, t in rows], DOCS)

    return make
