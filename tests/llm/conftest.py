import random

import pytest


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    from boutique.llm.frames import ship_code

    ship_code(spark)


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table with columns whose names the
    operators use themselves."""

    def make(rows):
        full = [(*r, *(None, None)[len(r) - 2:])[:4] for r in rows]
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "1 score", "'x' row", "2 node", "3 size", "4 items", "5 mask", "6 copies", "'7' spans", "8 keep_id")

    return make


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture
def rng():
    return random.Random(11)
