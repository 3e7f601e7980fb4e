import random

import pytest

SYLLABLES = "ba do ki lu men ra sto ti vo ze".split()
KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, class_id string, language string, secrets string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows, and columns that clash with results."""
    rows = [
        (1, prose(1, 40), "aa", "s1", None, "x", "y", "z", "q", "r"), (2, prose(2, 30), "aa", "s1", 5, *[None] * 5), (2, prose(2, 30), "aa", "s1", 5, *[None] * 5), (None, prose(3, 20), None, None, None, *[None] * 5),
        (4, None, "bb", "s2", 0, *[None] * 5), (5, "", "bb", "s2", 0, *[None] * 5), (6, " \n\t ", None, "s2", 3, *[None] * 5), (7, prose(4, 20_000), "bb", "s2", 1, *[None] * 5),
        (8, prose(1, 40), "aa", None, None, *[None] * 5), (9, "one", "bb", "s3", 3, *[None] * 5), (10, "Ünï 日本 😀 don't", "bb", "s3", 3, *[None] * 5),
    ]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)
