from __future__ import annotations

import numpy as np
import pytest

#: Clashing names on purpose: results and operators use these words too.
EXTRA = ("kept", "score", "row", "doc_id2")


@pytest.fixture
def texts(spark):
    """A table with nulls, empty and blank texts, ties, repeated rows, very long and odd texts, clashing columns."""
    rng = np.random.default_rng(5)
    syllables = ["an", "er", "in", "th", "ou", "re", "ti", "en", "st", "on"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    long = " ".join(word() for _ in range(30_000))
    base = " ".join(word() for _ in range(60))
    rows = [
        (1, base),
        (2, base.replace(" ", "  ")),
        (3, base + " tail"),
        (4, base),
        (4, base),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "one two"),
        (9, "One TWO"),
        (None, "no id but a text of some words"),
        (10, long),
        (11, long + "x"),
        (12, "12345 !!! 6789"),
        (13, "日本語の文章 です。 次の 行"),
        (14, "nul\0byte and <|endoftext|> inside"),
        (15, "é́ ▁ literal\r\n"),
    ]
    rows = [(i, t, "x", 1.0, "y", i) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double, row string, doc_id2 long").repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept string, lang string")
