"""Small tables with the odd rows that every operator has to bear."""

import random

import pytest

DOCS = "doc_id bigint, text string, n string, line int, node string, key string, id int"


@pytest.fixture
def docs_of(spark):
    """A documents table whose other columns have names that operators use inside."""
    def make(texts, ids=None):
        rows = [(i, t, "n", 7, "node", "key", -1) for i, t in
                zip(ids if ids is not None else range(len(texts)), texts)]
        return spark.createDataFrame(rows, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(30_000)]
    return [None, "", " \n\t ", "one", "it's  we'll\n\n x y", " ".join(words), "a" * 5000,
            "same text here", "same text here", "ΑΣ É ½ 日本 😀 \x1c <|endoftext|> <|startoftext|>z"]
