import pytest

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, fp string, block int, chunk int, rank int"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) rows, with further columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(t, i, "en", "s", None if t is None else len(t), "x", 1, 2, 3) for i, t in rows], SCHEMA)

    return make


#: Nulls, empties, white space alone, repeats, ties, a long text, other scripts.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "same text here"), (5, "same  text\there"), (6, "same text here"), (6, "same text here"), (7, "é ß 日本 🎉 x"), (8, "word " * 30_000), (9, "a\x00b \x1c c\x85d"), (None, "no id"),
]


@pytest.fixture
def odd(frame):
    return frame(ODD)
