"""Rows that every operator must take: null, empty, repeated, very long, clashing columns."""

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd(spark, words):
    """doc_id, text, lang, source, n_chars and columns named like outputs."""
    rng = random.Random(2)

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    long_one = text(60_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "de", "b"), (4, "one", "en", None), (5, long_one, "en", "b"),
        (6, long_one, "en", "b"), (7, text(40), "de", "c"), (7, text(40), "de", "c"), (None, text(30), None, "c"),
        (None, None, None, None), (8, "###!!! 123 \U0001f642 é", "fr", "a"), (9, text(40), "de", "c"), (9, text(200), "fr", "d"),
    ]
    rows = [(i, t, l, s, len(t or ""), "x", -1) for i, t, l, s in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words int"
    )
