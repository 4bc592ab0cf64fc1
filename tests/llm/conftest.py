"""Rows that every operator must bear: nulls, empty and long texts, repeats, columns with clashing names."""

import pytest

ODD = [
    (None, "the same old words in a row again and again"), (None, None), (50, None), (51, ""), (52, "   \n\n "),
    (53, "a b c d e " * 4000), (54, "a b c d e " * 4000), (55, "repeated row of six words"), (55, "repeated row of six words"),
    (55, "another text with the same id here"), (56, "x" * 60000), (57, "\U0001f600 é \t tab\r\nline"), (58, "!!! 123 ???"),
]
CLASHING = "doc_id long, text string, id long, key long, label string, n long, rank int, `a` long, b long, uid string, kept string"


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def documents_of(spark):
    def make(rows):
        return spark.createDataFrame([(d, t, 1, 2, "x", 3, 4, 5, 6, "u", "k") for d, t in rows], CLASHING)

    return make
