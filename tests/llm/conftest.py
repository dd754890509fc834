import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    parts = ("ba", "co", "di", "fu", "ge", "hol", "min", "per", "rat", "sul", "tor", "vi")
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeats, no key, as rows of `documents`."""
    rng = random.Random(7)
    text = sentence(rng, 120)
    rows = [
        (1, text, "en", "a", 1),
        (2, text, "en", "a", 1),
        (2, text, "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, "   \n\t ", "de", "b", 0),
        (6, "x", "fr", "b", 1),
        (7, "a" * 70_000, "fr", "b", 1),
        (8, sentence(rng, 20_000), "es", "c", 1),
        (9, "naïve 日本語 \U0001f600 é \x1c\x85 end", "es", "c", 1),
        (None, sentence(rng, 60), None, "c", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
