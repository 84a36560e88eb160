"""Documents for the tests of this folder."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """A DataFrame of documents from (doc_id, text) pairs; several partitions, optional further columns."""

    def make(pairs, more="", values=(), parts=3):
        rows = [(i, t, "en", "s", None if t is None else len(t), *values) for i, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS + (", " + more if more else "")).repartition(parts)

    return make


@pytest.fixture
def odd_documents():
    """Null and repeated ids, null, empty, blank and one-letter texts, repeated rows, white space of all kinds."""
    shared = " ".join(f"w{n}" for n in range(40))
    return [
        (1, shared), (2, "x " + shared + " y"), (2, "x " + shared + " y"), (3, None), (4, ""), (5, " \t\n "), (6, "a"),
        (None, shared), (None, None), (7, "Ünïcödé text here"), (8, "\x0bv\x0ct\r\nn\tt  two"), (9, shared),
        (10, "long" * 5_000), (11, " ".join(["very long"] * 4_000)), (12, "zz " + shared),
    ]


@pytest.fixture
def some_documents():
    """Texts of a few hundred words with copies, near copies and shared passages, the same each time."""
    chance = random.Random(5)
    vocabulary = [f"{chance.choice('bcdfghkl')}{chance.choice('aeiou')}{n}" for n in range(400)]
    text = lambda n: [chance.choice(vocabulary) for _ in range(n)]
    passage, out = text(60), []
    bases = [text(chance.randint(20, 300)) for _ in range(30)]
    for n in range(150):
        words = list(bases[n % 30]) if n % 3 else text(chance.randint(0, 200))
        for _ in range(chance.choice([0, 0, 1, 3, 12])):
            if words:
                words[chance.randrange(len(words))] = chance.choice(vocabulary)
        if n % 7 == 0:
            at = chance.randint(0, len(words))
            words[at:at] = passage
        out.append((1000 - n if n % 2 else n, chance.choice([" ", "  ", "\n"]).join(words)))
    return out


def collected(frame, *columns):
    frame = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
