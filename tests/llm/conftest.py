import random

import pytest

from gridloom.llm.text import prepare

SCHEMA = "doc_id long, text string, source string, label string, node int, size int, _h string"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def table(llm):
    def make(rows, schema="doc_id long, text string, source string"):
        return llm.createDataFrame(rows, schema)

    return make


LONG = " ".join(f"w{i % 977}x{i * i % 1009}" for i in range(60_000))


@pytest.fixture(scope="session")
def messy(llm):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing extra columns."""
    line = "the same line of some length in many texts"
    texts = [
        (1, "", "a"), (2, None, None), (3, " \n\t\n", "a"), (4, LONG, "b"), (5, line, "b"), (5, line, "b"),
        (5, "another text with the same id as others have", None), (None, line, "b"), (None, None, None),
        (6, "É ßtraße 日本語 😀 x y\n" + line, "c"), (7, "a", "c"), (8, line.upper(), "c"), (9, "...\n...", None),
    ]
    return llm.createDataFrame([(i, t, s, "z", 1, None, "h") for i, t, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


def speak(seed, n, words=("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
