"""Texts for the tests of the corpus operators."""

import random


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in any column, empty and blank texts, a long text, exact copies, repeated rows, near copies, shared passages."""
    long = words(1, 6000)
    passage = words(2, 60)
    near = words(3, 120)
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "a"), (4, long, "en", "a"), (5, long, "en", None),
        (6, "one two", "en", "b"), (7, "One  two", "en", "b"), (8, words(4, 30) + " " + passage, "de", "b"),
        (9, words(5, 40) + " " + passage + " " + words(6, 20), "de", "a"), (10, near, "fr", "a"), (11, near + " tail", "fr", "a"),
        (12, "head " + near, "fr", "a"), (13, near, None, "c"), (13, near, None, "c"), (14, "a" * 700, "en", "c"),
        (15, "é" * 150 + words(7, 20), "fr", "c"), (None, near, "en", "a"), (None, None, None, None), (16, "###!!! 123", "en", "a"),
        (17, passage + " " + passage, "en", "a"), (18, "x", "en", "a"), (19, words(8, 300), "en", "d"), (20, words(8, 300).upper(), "en", "d"),
    ]
    return [(i, t, g, s, len(t) if t is not None else None, "n", "i", "k", "s", "l") for i, t, g, s in rows]
