import numpy as np
import pytest


class Sets:
    """Union-find over any ids: the smallest of a set is its name."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.fixture
def sets():
    return Sets()


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(5)


#: Nulls, empty and long texts, repeated rows, ties, signs of several bytes.
ODD_TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (4, "a"), (5, "one two three four five six"), (6, "one two three four five six"),
    (None, "one two three four five six"), (None, None), (7, "ÀÉ ß 😀 ǅ ́x"), (8, "x" * 70_000), (9, "Der Hund läuft. " * 9_000), (10, "!!! ??? 123"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with extra columns whose names clash with those of the operators."""
    rows = [(i, t, "en" if k % 2 else "de", 0.5, "x", k, "many", "m") for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, fp string, size int, n_chars string, _marks string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
