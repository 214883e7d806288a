"""Small tables with the odd cases that every operator has to bear."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, ids string, marks int, row int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns named like the operators' own."""
    long_text = " ".join(f"word{i % 977} token{i % 13}." for i in range(40_000))
    texts = [
        (1, "the same text here"), (2, "the  same\ttext here"), (2, "the  same\ttext here"), (3, None), (4, ""), (5, " \n\t "),
        (None, "the same text here"), (None, None), (6, long_text), (7, long_text + " end"), (8, "12345 !!"), (9, "ééé ß \u0000 😀 ▁x ﬁ"),
        (10, "a"), (11, "user = bob\npassword = hunter22\nhttps://host.example/login"), (11, "another text with the same id"),
    ]
    rows = [(i, t, None if k % 4 == 0 else "en", None, None, 0.5, 7, "x", None, 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
