import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, row string, size int, block string"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls everywhere, empty and very long texts, repeats, ties, odd white space, clashing column names."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    near = long.rsplit(" ", 3)[0]
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a", 5, 1, "r", 3, "b"),
        (2, "Alpha  BETA\tgamma delta epsilon", "en", "a", 5, 1, "r", 3, "b"),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, None, None, None, None),
        (5, "  \n\t ", "en", "", 4, None, None, None, None),
        (6, "one two", "en", "b", 7, None, None, None, None),
        (7, "one two", "en", None, 7, None, None, None, None),
        (7, "one two", "en", None, 7, None, None, None, None),
        (8, long, "en", "a", 1, None, None, None, None),
        (9, near, "en", "é", 1, None, None, None, None),
        (None, "no id at all", "en", "a", 1, None, None, None, None),
        (11, "Ünï  code  　日本 x\r\n y  z   ", "xx", "b", 1, None, None, None, None),
        (12, "x" * 50_000, "en", "c", 1, None, None, None, None),
        (13, "card 4111 1111 1111 1111 and mail jo.doe+1@mail.example.com on 2021-03-04", "en", "c", 1, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
