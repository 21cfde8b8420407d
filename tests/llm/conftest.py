import pytest


@pytest.fixture()
def docs_of(spark):
    """A documents table of texts, with columns whose names clash with outputs."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", None if t is None else len(t), 1, True) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept boolean").repartition(3)

    return make


ODD = [None, "", " \n\t ", "one", "x" * 30000, "word " * 4000, "é😀 ñ b", "same text of some words here ok", "same text of some words here ok", "a\x00b", "<|end|> [INST] </s> \\"]


@pytest.fixture()
def odd():
    return list(ODD)
