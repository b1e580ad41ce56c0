import random

import pytest


@pytest.fixture(scope="session")
def make_text():
    """Texts of invented words from a seed."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, make_text):
    """Null, empty, blank and very long texts, null and repeated ids, repeated rows, and columns with clashing names."""
    long = make_text(1, 20_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "o n e"), (7, long), (8, long + " "), (9, make_text(2, 60)), (9, make_text(2, 60)), (None, "one"), (10, "日本語 é <|endoftext|> \x00 x"), (9, make_text(3, 60))]
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 7, "x", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, bin long, h string, v int")
