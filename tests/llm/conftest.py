import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rng = random.Random(11)
    words = ["the", "and", "Éan", "zu", "xyz.", "of", "loser", "a,", "in", "ünd"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [None, "", "  \n\t ", "one", "Two words", long, long + " tail", "same text here", "same text here"]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None if t is None else len(t), "n", 1.5, i) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", "en", "s", 12, None, None, None), rows[-1], rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "n_tokens string, score double, component_id long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
