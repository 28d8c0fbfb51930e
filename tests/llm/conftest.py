from __future__ import annotations

import random

import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash with results."""
    rows = [(1, "One two three four", "a"), (1, "One two three four", "a"), (1, "another text of that key", "a"), (2, None, None), (3, "", "b"), (None, "no key here at all", "b"), (4, LONG, "a"), (5, "One two three four", "b"), (6, " \t\n ", "c")]
    schema = "doc_id long, text string, source string, score string, predicted string, slot string, block string, round string, in_block string, key string, fp string, component string, shard string, size string, ids string, label string"
    return spark.createDataFrame([(*r, *["x"] * 13) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def marked(spark):
    """Texts of two kinds and their labels."""
    r = random.Random(5)
    good, bad = [f"good{i}" for i in range(300)], [f"vile{i}" for i in range(12)]
    rows = [(i, " ".join(r.choices(good, k=40) + (r.choices(bad, k=10) if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, mark int")
