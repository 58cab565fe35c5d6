"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

#: name -> texts; the operators' results on these are checked against plain Python.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(text: str, every: int, word: str = "changed") -> str:
    words = text.split(" ")
    for i in range(every, len(words), every):
        words[i] = f"{word}{i}"
    return " ".join(words)


def awkward_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, keys): nulls anywhere, empties, a very long text, ties, repeated rows, clashing columns."""
    long = prose(1, 30_000)
    a, b = prose(2, 300), prose(3, 120)
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (2, a, "en", "s1"), (3, edited(a, 97), "en", "s2"), (4, b, None, None), (5, None, "en", "s1"), (6, "", "de", "s2"), (7, " \n\t ", None, None),
        (8, long, "en", "s1"), (9, "one two", "fr", "s3"), (10, "ONE two", "fr", None), (11, b + "\n" + b, "de", "s2"), (None, a + " tail", "en", "s1"), (None, None, None, None), (12, prose(4, 50), "en", "s1"), (13, prose(5, 50), "en", "s1"),
        (14, "x " * 200, "en", "s4"), (15, "x " * 100 + "y", "en", "s4"), (16, "word", "en", "s5"), (17, "é ü ß " * 30, "de", "s5"),
    ]
    return [(i, t, lang, source, len(t or ""), "k") for i, t, lang, source in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string"


def awkward(spark):
    return spark.createDataFrame(awkward_documents(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
