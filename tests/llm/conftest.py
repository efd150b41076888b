"""Small hand-made documents for the training-data operators."""

from __future__ import annotations

import random

import pytest


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """(doc_id, text): copies, near copies, shared passages, runs, ties, nulls, empties, wide characters, repeated rows."""
    rng = random.Random(4)
    passage, base = sentence(rng, 60), sentence(rng, 200)
    near = base.split()
    rows = [(1, base), (2, base), (3, " ".join(near[:100] + ["new"] + near[101:])), (4, " ".join(near[:150]) + " " + sentence(rng, 90))]
    rows += [(10 + i, f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}") for i in range(4)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, "one two"), (24, "One TWO"), (25, "a b c d e"), (26, "x" * 500), (27, "ab" * 300)]
    rows += [(28, "Then " * 120), (29, "é" * 130 + " ü"), (30, sentence(rng, 40) + "\n" + sentence(rng, 40)), (31, "\n".join(["same line here"] * 30))]
    rows += [(32, passage[: len(passage) // 2]), (33, passage + " " + passage), (34, "naïve façade " * 40)]
    rows += [(40 + i, " ".join(near[: 150 + 10 * i])) for i in range(5)]
    rows += [(60, sentence(rng, 6000))]
    rows += [(61, rows[-1][1][:20_000] + " end " + sentence(rng, 10))]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    rows = [(*r, "en", "s", 1) for r in hard_rows]
    rows += [(None, "a text without an id " * 10, "en", "s", 1), (1, hard_rows[0][1], "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
