import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, words string, anchor long"


def sentence(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, ties."""
    rnd = random.Random(3)
    base = sentence(rnd, 120)
    texts = [None, "", " \t\n", "one", base, base, base + " more words here", sentence(rnd, 6000), "Ünïcode čaj 漢字   nbsp", "a\x1cb\x85c d"]
    texts += [sentence(rnd, rnd.randrange(1, 200)) for _ in range(20)]
    rows = [(k, t, "en" if k % 3 else None, None if k % 7 == 0 else f"s{k % 3}", len(t or ""), 7, "x", "y", 1) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[1], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture()
def edge_docs(spark, edge_rows):
    """The same with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
