"""Small tables with the cases that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in it is that was for on are as with his they at be this from have or by one had not but what all were".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, odd characters."""
    text = prose(1, 120)
    return [
        (1, text, "en", "a", len(text)),
        (1, text, "en", "a", len(text)),
        (2, text, "en", None, None),
        (3, None, "en", "a", 0),
        (None, text, None, "a", None),
        (None, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, "é▁😀\x00 x", "fr", "b", 6),
        (7, prose(2, 30000), "en", "b", None),
        (8, "a" * 20000, None, "b", None),
        (9, "one two three", "en", "c", 13),
    ]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
