import random

import pytest
from helpers import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h long, line string, words string, __q_id long, __q_row string, __q_doc int, __q_host int, `a.b` string, n int"


def row(i, text, lang="en", source="s1"):
    """A document with extra columns whose names operators use inside."""
    return (i, text, lang, source, None if text is None else len(text), "x", 7, "y", "z", 5, "r", 6, 8, "dot", 9)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, blank, one-word and very long texts, copies, near copies, ties and rows given twice."""
    rng = random.Random(3)
    a, b = prose(rng, 120), prose(rng, 90)
    near = a.split()
    near[60] = "changed"
    long = "\n".join(prose(rng, 12) for _ in range(3000))
    shared = "this very line is shared by a number of documents here"
    rows = [
        (1, a), (2, a), (3, " ".join(near)), (4, b + "\n" + shared), (5, None), (6, ""), (7, "   \n\t\n"), (8, "word"), (9, long),
        (10, shared + "\n" + prose(rng, 40)), (11, prose(rng, 30) + "\n  " + shared.upper() + " \n" + shared), (12, prose(rng, 60), None, None),
        (None, prose(rng, 50) + "\n" + shared), (13, a), (13, a), (14, "short text of five words"), (15, "short text of five words"),
        (16, b[:200] + " " + prose(rng, 50)), (17, "äöü ß " * 40), (18, a + " " + a),
    ]
    return rows
