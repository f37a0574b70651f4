import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    text = words(rng, 40)
    return [(1, text, "en", "s", None), (2, text, "en", "s", None), (2, text, "en", "s", None),
            (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n\t ", "en", "s", 4),
            (None, text + " ", "en", None, 7), (None, None, None, None, None),
            (6, words(rng, 30_000), "en", "s", 1), (7, "x" * 50_000, "en", "s", 50_000),
            (8, "漢字 仮名 é 😀  ok", "de", "s", 3), (9, "123 !!", "de", "s", 6)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
