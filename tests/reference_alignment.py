"""The alignment rule written out cell by cell, to check the batched one against."""

from __future__ import annotations

import math


def align(sequence: str, profile: list[dict[str, float]]) -> str:
    columns, letters = len(profile), len(sequence)
    band = max(75, abs(columns - letters) + 20)
    never = -1e9
    score = {(0, 0): (0.0, never, never)}
    came = {}

    def at(i, j):
        return score.get((i, j), (never, never, never))

    for i in range(columns + 1):
        for j in range(letters + 1):
            if i == j == 0:
                continue
            if j == 0 or i == 0:
                steps = i + j
                if steps <= band:
                    gap = -5 - 2 * (steps - 1)
                    score[i, j] = (never, gap, never) if j == 0 else (never, never, gap)
                came[i, j] = (0, 1, 2)
            elif abs(i - j) <= band:
                share = profile[i - 1].get(sequence[j - 1], 0)
                fit = 2 * math.log(share / 0.05) if share > 0 else 0 if "X" in profile[i - 1] else -5
                paired = [s + fit for s in at(i - 1, j - 1)]
                skip = (at(i - 1, j)[0] - 5, at(i - 1, j)[1] - 2)
                keep = (at(i, j - 1)[0] - 5, at(i, j - 1)[2] - 2)
                score[i, j] = (max(paired), max(skip), max(keep))
                came[i, j] = (paired.index(max(paired)), 0 if skip[0] >= skip[1] else 1, 0 if keep[0] >= keep[1] else 2)
    i, j = columns, letters
    state = at(i, j).index(max(at(i, j)))
    signs = []
    while i or j:
        origin = came[i, j][state]
        signs.append("-" if state == 1 else sequence[j - 1])
        i, j = i - (state != 2), j - (state != 1)
        state = origin
    return "".join(reversed(signs))
