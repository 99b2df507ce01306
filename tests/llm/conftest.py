import random

import pytest

SF = "/root/testdata/sf0.001"
# Columns whose names the operators use themselves.
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars int, score string, kept string, shard string, "
          "_row string, hash string, word string, spans string, row string")


def rows(*pairs):
    return [(i, t, "en" if i else None, None, None, "x", "y", "z", "r", "h", "w", "s", "o") for i, t in pairs]


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text) pairs with further columns, several of clashing names."""
    return lambda *pairs: spark.createDataFrame(rows(*pairs), SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Invented words: prose(seed, n) is a text of n of them."""
    def text(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("bcdfghjklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))

    return text


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
