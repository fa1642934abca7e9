import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string, spans string, score string, mark string, n_lines string"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "k", None, "x", "y", None, "z") for d, t in rows], SCHEMA)

    return make


ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two"), (6, "a line that is long enough to count\n" * 3),
    (7, "a line that is long enough to count\nother"), (7, "a line that is long enough to count\nother"), (None, "a line that is long enough to count\nthird"),
    (8, "ünïcödé ßtraße 日本語 \U0001f600 " * 20), (9, "word " * 40_000), (10, "x" * 100_000), (11, "1234567890" * 3000), (12, "\x00\x1c a b c"),
]
"""Nulls, empty texts, blanks, short ones, repeated lines, repeated rows, a row without id, other scripts, very long texts."""


@pytest.fixture
def odd(frame):
    return frame(ODD)
