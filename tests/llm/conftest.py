import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Odd rows: null and empty texts, ties, repeated rows, null ids and sources, one long text, clashing columns."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \t ", "en", None, 4),
        (4, "The quick brown fox, write to jo@mail.example.org", "en", "b", 1), (4, "The quick brown fox, write to jo@mail.example.org", "en", "b", 1),
        (5, "the QUICK brown fox, write to jo@mail.example.org", "en", "b", 1), (None, "no id at all here", None, "c", 1),
        (6, "long word " * 6000, "en", "c", 60000), (7, "é" * 300 + " ñ", "fr", "a", 302), (8, "one", "en", "d", 3),
    ]
    clash = "size long, key string, fp long, tag long, base string, spans string, score double, h1 long, packed string, row string, __text string, extra string, `a.b` string, cuts string, w_id long, words string"
    return spark.createDataFrame([(*r, 1, "k", 2, 3, "b", "s", 0.5, 4, "p", "r", "t", "x", "dot", "c", 5, "w") for r in rows], f"{DOCS}, {clash}")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
