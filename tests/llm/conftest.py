import os
import random

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture
def docs(spark):
    """documents of (doc_id, text), with columns whose names clash with those that operators make."""
    def make(rows, parts=3):
        rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, "x") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, bundle int, score string"
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make


@pytest.fixture
def prose():
    def make(n, seed, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    return make


@pytest.fixture
def odd(prose):
    """Null, empty, blank, one word, other scripts, repeated rows, very long."""
    long = prose(60_000, 1)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "naïve 漢字 🙂 Ünï"), (6, long), (7, long[:200_000] + " end"), (8, prose(120, 2)),
            (8, prose(120, 2)), (9, prose(120, 2)), (10, "a b " * 60), (11, "a b " * 70), (None, prose(130, 3)), (12, prose(130, 3))]


os.environ.setdefault("OMP_NUM_THREADS", "1")
