import pytest


@pytest.fixture
def docs(spark):
    """A table of documents with what is awkward: nulls, empty texts, repeated rows, ties, other columns of clashing names."""

    def make(rows):
        full = [(i, t, "en", s, len(t or ""), "x", True, 7) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id string, toxic_flag boolean, node int")

    return make


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture
def awkward(docs):
    return docs([(1, "a plain short text of words", "s1"), (1, "a plain short text of words", "s1"), (2, None, "s1"), (3, "", None), (None, "no id here at all", "s2"), (4, "   \n\t ", "s2"), (5, LONG, "s2"), (6, LONG + " end", "s3"), (7, "a plain short text of words", "s3"), (8, "éàü ß 桌面 \U0001f600", "s3")])


@pytest.fixture
def empty(docs, spark):
    return docs([(1, "x", "s")]).filter("doc_id < 0")
