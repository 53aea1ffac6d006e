import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, n long, sid long, label int"


def doc(i, text, lang="en", source="a"):
    """A row of documents with extra columns whose names the operators use inside."""
    return (i, text, lang, source, None if text is None else len(text), -7, 0.25, -1, -2, 9)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [doc(1, base), doc(2, base), doc(2, base), doc(3, base + " again"), doc(4, ""), doc(5, None), doc(6, " \t\n"),
            doc(7, "one two"), doc(8, "One TWO"), doc(9, "word " * 30000), doc(10, "a@b.co, +1 (555) 555-2485, 10.0.0.1, 4242424242424242", None, None),
            (11, "no language at all in this row of the table", None, None, None, None, None, None, None, None),
            (None, base, None, None, None, None, None, None, None, None), doc(12, "é😀 ünï çödé 漢字 " * 40, "de", "b")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
