from __future__ import annotations

import random

import pytest
from conftest import rows
from reference_alignment import align

from epitrove.operators.alignment import align_group, align_references
from epitrove.operators.frequencies import load_profile


def random_profile(dice, columns):
    profile = []
    for _ in range(columns):
        letters = dice.sample("ACDEFGHIKLMNPQRSTVWYX-", dice.randint(0, 4))
        weights = [dice.random() + 0.01 for _ in letters]
        profile.append({a: w / sum(weights) for a, w in zip(letters, weights)})
    return profile


@pytest.mark.parametrize("seed", range(8))
def test_batched_alignment_equals_the_rule(seed):
    dice = random.Random(seed)
    profile = random_profile(dice, dice.choice([0, 1, 7, 60, 110]))
    typical = "".join(max(c, key=c.get) if c else "A" for c in profile).replace("-", "")
    sequences = ["".join(dice.choices("ACDEFGHIKLMNPQRSTVWYXb", k=dice.choice([0, 1, 5, 50, 200]))) for _ in range(5)]
    sequences += [typical[:dice.randint(0, len(typical))] + typical[dice.randint(0, len(typical)):] for _ in range(5)]
    assert align_group(sequences, profile) == [align(s, profile) for s in sequences]


def test_references_get_the_profile_of_their_protein(spark):
    dice = random.Random(7)
    texts = {"M1": "MKTAYIAKQRQISF", "NP": "GGSSGLVPRGSH"}
    stored = spark.createDataFrame(
        [(p, i, letter, 0.9) for p, text in texts.items() for i, letter in enumerate(text, 1)] + [("M1", 3, "-", 0.1)],
        "protein string, position int, aminoacid string, value double")
    raw = [(n, p, text[:cut] + text[cut + 3:]) for p, text in texts.items() for n, cut in enumerate(dice.choices(range(9), k=40))]
    raw += [(n, " m 1", "MKTAYIAKQRQISF") for n in range(30)] + [(0, "XX", "MKT"), (0, "M1", None), (0, "M1", "")]
    references = spark.createDataFrame(raw, "n int, protein string, raw_sequence string")
    profile = load_profile(stored)
    aligned = align_references(references, profile, group_size=4)
    columns = {p: [{"M1": {}, "NP": {}}[p] | {letter: 0.9} for letter in text] for p, text in texts.items()}
    columns["M1"][2]["-"] = 0.1
    expected = []
    for n, protein, text in raw:
        key = protein.replace(" ", "").upper()
        expected.append((n, protein, text, align(text, columns[key]) if key in columns and text is not None else None))
    assert rows(aligned) == rows(spark.createDataFrame(expected, "n int, p string, r string, a string"))
    for row in aligned.where("aligned_sequence is not null").collect():
        assert row["aligned_sequence"].replace("-", "") == row["raw_sequence"]
