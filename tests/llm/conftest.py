import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    """Words of an invented language, the same every time."""
    rng = random.Random(4)
    return ["".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "ba", "re", "vo"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd(make, words):
    """Nulls, empty, blank, tiny, non-ASCII and very long texts, repeated rows, a null id; and a column named kept."""
    from pyspark.sql import functions as F

    long = " ".join(words * 8)
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "a"), (5, "é ñ"), (6, long), (7, "same text here"), (7, "same text here"), (None, "no id at all"), (8, None, None, None), (9, "\n\n"), (10, "x" * 5000)]
    return make(*rows).withColumn("kept", F.lit("mine")).withColumn("bucket", F.lit(1))


@pytest.fixture(scope="session")
def empty(make):
    return make()
