from __future__ import annotations

import random

import pytest

VOCABULARY = ["".join(random.Random(k).choices("abcdefghij", k=2 + k % 5)) for k in range(400)]


@pytest.fixture()
def frame(spark):
    """Documents from (doc_id, text) rows, with columns named like the operators' own."""
    def make(rows, parts: int = 3):
        return spark.createDataFrame(
            [(i, t, "en", "s", None, 1.5, 7) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, "
            "component_id double, node long").repartition(parts)
    return make


@pytest.fixture()
def prose():
    """Deterministic invented prose: ``prose(seed, n_words)``."""
    def make(seed: int, n: int) -> str:
        return " ".join(random.Random(seed).choices(VOCABULARY, k=n))
    return make

