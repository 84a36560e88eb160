"""Global alignment of reference sequences to the residue profile of their protein.

The dynamic programme needs Python workers. Spark decides what they get: distinct sequences only,
in groups of one protein whose size is bounded, each with that protein's profile. Inside a group
sequences with the same band are aligned together, one anti-diagonal of the tables at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from epitrove.functions.text import protein_key
from epitrove.plans.joins import lookup_join
from epitrove.plans.storage import pin

# The scoring of the alignment.
GAP_OPEN = -5.0
GAP_EXTEND = -2.0
BACKGROUND = 0.05
UNSEEN = -5.0
LEAST_BAND = 75
BAND_MARGIN = 20
NEVER = -1e9

GROUP_SEQUENCES = 256
TABLE_CELLS = 40_000_000
MATCH, DELETE, INSERT = 0, 1, 2


def column_scores(profile: list[dict[str, float]], alphabet: str) -> np.ndarray:
    """Score of every letter in every profile column; unknown letters share the last place."""
    scores = np.full((len(profile), len(alphabet) + 1), UNSEEN)
    for column, shares in enumerate(profile):
        if "X" in shares:
            scores[column] = 0.0
        for letter, share in shares.items():
            if share > 0 and letter in alphabet:
                scores[column, alphabet.index(letter)] = 2.0 * np.log(share / BACKGROUND)
    return scores


def band_width(columns: int, length: int) -> int:
    return max(LEAST_BAND, abs(columns - length) + BAND_MARGIN)


def trace_together(codes: np.ndarray, lengths: np.ndarray, scores: np.ndarray, band: int) -> np.ndarray:
    """Traces of the sequences ``codes`` (padded to one length) against the profile ``scores``.

    Returns, per sequence, the steps from the end to the start: 0 pairs a letter with a column, 1
    skips a column, 2 keeps a letter without one; -1 fills up. No path enters the padding, as a
    path only leads to smaller places than its sequence's end.
    """
    count, length = codes.shape
    columns = len(scores)
    ends = columns + lengths
    shape = (count, columns + 1)
    # Scores on the last two anti-diagonals, indexed by the column number.
    before = [np.full(shape, NEVER) for _ in range(3)]
    last = [np.full(shape, NEVER) for _ in range(3)]
    last[MATCH][:, 0] = 0.0
    # Where each of the three states came from, for the columns of every anti-diagonal that are in the band.
    left = -((band - np.arange(columns + length + 1)) // 2)
    origin = np.zeros((3, columns + length + 1, count, band + 1), dtype=np.int8)
    origin[DELETE], origin[INSERT] = DELETE, INSERT
    final = np.zeros((3, count))
    final[:, ends == 0] = np.array([[0.0], [NEVER], [NEVER]])
    for diagonal in range(1, columns + length + 1):
        now = [np.full(shape, NEVER) for _ in range(3)]
        if diagonal <= min(band, columns):
            now[DELETE][:, diagonal] = GAP_OPEN + (diagonal - 1) * GAP_EXTEND
        if diagonal <= min(band, length):
            now[INSERT][:, 0] = GAP_OPEN + (diagonal - 1) * GAP_EXTEND
        at = np.arange(max(1, diagonal - length), min(columns, diagonal - 1) + 1)
        at = at[np.abs(2 * at - diagonal) <= band]
        if at.size:
            fit = scores[at - 1][np.arange(at.size), codes[:, diagonal - at - 1]]
            paired = np.stack([before[state][:, at - 1] + fit for state in (MATCH, DELETE, INSERT)])
            choice = paired.argmax(axis=0)
            now[MATCH][:, at] = np.take_along_axis(paired, choice[None], axis=0)[0]
            origin[MATCH, diagonal][:, at - left[diagonal]] = choice
            for state, source in ((DELETE, at - 1), (INSERT, at)):
                opened = last[MATCH][:, source] + GAP_OPEN
                extended = last[state][:, source] + GAP_EXTEND
                now[state][:, at] = np.maximum(opened, extended)
                origin[state, diagonal][:, at - left[diagonal]] = np.where(opened >= extended, MATCH, state)
        before, last = last, now
        ending = ends == diagonal
        for state in (MATCH, DELETE, INSERT):
            final[state, ending] = now[state][ending, columns]

    rows = np.arange(count)
    column = np.full(count, columns)
    diagonal = ends.copy()
    state = final.argmax(axis=0)
    steps = np.full((count, columns + length), -1, dtype=np.int8)
    for step in range(columns + length):
        going = diagonal > 0
        if not going.any():
            break
        steps[going, step] = state[going]
        came_from = origin[state, diagonal, rows, np.clip(column - left[diagonal], 0, band)]
        diagonal = np.where(going, diagonal - np.where(state == MATCH, 2, 1), diagonal)
        column = np.where(going & (state != INSERT), column - 1, column)
        state = np.where(going, came_from, state)
        diagonal, column = np.maximum(diagonal, 0), np.maximum(column, 0)
    return steps


def _written(sequence: str, steps: np.ndarray) -> str:
    signs, at = [], 0
    for step in steps[steps >= 0][::-1]:
        if step == DELETE:
            signs.append("-")
        else:
            signs.append(sequence[at])
            at += 1
    return "".join(signs)


def align_group(sequences: list[str], profile: list[dict[str, float]]) -> list[str]:
    """Aligned text of each sequence; sequences with the same band share the tables."""
    alphabet = "".join(sorted({letter for column in profile for letter in column if len(letter) == 1}))
    scores = column_scores(profile, alphabet)
    place = {letter: i for i, letter in enumerate(alphabet)}
    aligned = [""] * len(sequences)
    by_band: dict[int, list[int]] = {}
    for number in sorted(range(len(sequences)), key=lambda n: len(sequences[n])):
        by_band.setdefault(band_width(len(profile), len(sequences[number])), []).append(number)
    for band, members in by_band.items():
        longest = len(sequences[members[-1]])
        cells = 3 * (len(profile) + longest + 1) * (band + 1)
        at_once = max(1, TABLE_CELLS // cells)
        for first in range(0, len(members), at_once):
            chunk = members[first:first + at_once]
            lengths = np.array([len(sequences[m]) for m in chunk])
            codes = np.full((len(chunk), lengths.max()), len(alphabet))
            for row, member in enumerate(chunk):
                codes[row, :lengths[row]] = [place.get(letter, len(alphabet)) for letter in sequences[member]]
            for member, steps in zip(chunk, trace_together(codes, lengths, scores, band)):
                aligned[member] = _written(sequences[member], steps)
    return aligned


def _align_pandas(key: tuple, sequences: pd.DataFrame, profile: pd.DataFrame) -> pd.DataFrame:
    columns = [dict(shares) for shares in profile.sort_values("position")["shares"]]
    texts = sequences["raw_sequence"].tolist()
    return pd.DataFrame({
        "protein_key": key[0],
        "raw_sequence": texts,
        "aligned_sequence": align_group(texts, columns) if columns else [None] * len(texts),
    })


def align_references(references: DataFrame, profile: DataFrame, group_size: int = GROUP_SEQUENCES) -> DataFrame:
    """Add ``aligned_sequence`` to ``(protein, raw_sequence)`` rows; NULL where there is no profile.

    ``profile`` comes from ``load_profile``. Equal sequences are aligned once. A protein with many
    sequences is cut into groups of about ``group_size``, each of which gets a copy of the profile.
    """
    keyed = references.withColumn("protein_key", protein_key(F.col("protein")))
    distinct = keyed.select("protein_key", "raw_sequence").where("raw_sequence is not null").distinct()
    # One row per protein, used twice.
    counts = pin(distinct.groupBy("protein_key").agg(F.ceil(F.count(F.lit(1)) / group_size).cast("int").alias("groups")))
    grouped = lookup_join(distinct, counts, "protein_key", "inner").withColumn(
        "part", F.pmod(F.xxhash64("raw_sequence"), F.col("groups")).cast("int")
    )
    shares = profile.select(protein_key(F.col("protein")).alias("protein_key"), "position", "shares")
    copies = shares.join(counts, "protein_key").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    )
    aligned = (
        grouped.select("protein_key", "part", "raw_sequence").groupBy("protein_key", "part")
        .cogroup(copies.select("protein_key", "part", "position", "shares").groupBy("protein_key", "part"))
        .applyInPandas(_align_pandas, "protein_key string, raw_sequence string, aligned_sequence string")
    )
    return lookup_join(keyed, aligned, ["protein_key", "raw_sequence"], "left").select(
        *references.columns, "aligned_sequence"
    )
