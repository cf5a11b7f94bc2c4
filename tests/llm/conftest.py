import random

import pytest

WORDS = "the of and river stone light paper green house quiet morning letter summer winter field cloud garden music window road".split()


@pytest.fixture
def prose():
    def make(seed, n, words=WORDS):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as documents with columns whose names clash with results."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, row string, fp string, kept string, items string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "f", "k", "m") for i, t in rows], schema)

    return make
