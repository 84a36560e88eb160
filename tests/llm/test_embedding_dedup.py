from __future__ import annotations

import numpy as np
import pytest
from llm_fixtures import collected

from epitrove.llm import embedding_dedup as ed
from epitrove.llm.embedding_dedup import near_duplicates


def brute(rows, threshold):
    """Links between all pairs of usable vectors of one length, and what they reach."""
    usable = [bool(v and None not in v and np.isfinite(v).all() and any(v)) for _, v in rows]
    units = [np.array(v, float) / np.abs(v).max() / np.linalg.norm(np.array(v, float) / np.abs(v).max()) if u else None for (_, v), u in zip(rows, usable)]
    linked = [[b for b in range(len(rows)) if a != b and usable[a] and usable[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold] for a in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        for a, near in enumerate(linked):
            for b in near:
                label[a] = label[b] = min(label[a], label[b])
    out = []
    for n, (vec_id, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[n] and rows[m][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(linked[n]), component, vec_id is None or vec_id == component))
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def made(count, seed, hot):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(12, 16))
    rows = []
    for n in range(count):
        base = centres[0] if n < hot else centres[n % 12] if n % 4 == 0 else chance.normal(size=16)
        vector = (base + chance.normal(size=16) * chance.choice([0.0, 0.1, 0.25])).astype(np.float32)
        rows.append((1000 - n, [float(x) for x in vector]))
    return rows


@pytest.mark.parametrize("block, vectors, hot", [(2_048, 128, 10), (32, 4, 150)])
def test_equals_brute_force(spark, monkeypatch, block, vectors, hot):
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "CELL_VECTORS", vectors)
    rows = made(400, block, hot)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert collected(near_duplicates(table, 0.9, recall=1.0)) == brute(rows, 0.9)


def test_recall_of_random_cells_reaches_the_target(spark, monkeypatch):
    monkeypatch.setattr(ed, "CELL_VECTORS", 2)
    rows = made(600, 5, 100)
    found = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9).collect()
    expected = {r[0]: r[1] for r in brute(rows, 0.9)}
    assert all(r.n_links <= expected[r.vec_id] for r in found)
    assert sum(r.n_links for r in found) >= 0.9 * sum(expected.values())


ODD = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
       (8, [float("inf"), 1.0]), (None, [1.0, 0.02]), (None, [0.0, -1.0]), (9, [1e300, 1e290]), (10, [1e-300, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [-1.0, 0.0])]


def test_odd_vectors(spark):
    table = spark.createDataFrame([(*r, 1, "k") for r in ODD], "vec_id long, embedding array<double>, node int, kept string")
    assert collected(near_duplicates(table, 0.9)) == brute(ODD, 0.9)


def test_nothing_to_compare(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    alone = spark.createDataFrame([(3, None), (4, [0.0])], "vec_id long, embedding array<float>")
    assert collected(near_duplicates(alone)) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_cells_come_in_the_order_of_their_distance():
    chance = np.random.default_rng(3)
    index = ed.Index(ed.unit(chance.normal(size=(300, 8))), 7)
    rows = ed.unit(chance.normal(size=(40, 8)))
    ones, twos = index.distances(rows)
    grid = (ones[:, :, None] + twos[:, None, :]).reshape(40, -1)
    for count in (1, 5, 49):
        found = index.visits(rows, count)
        assert np.allclose(np.take_along_axis(grid, found, 1), np.sort(grid, axis=1)[:, :count])
    home = index.visits(rows, 1)[:, 0]
    assert (index.rank(rows, home) == 0).all()


def test_recall_holds_where_links_are_rare(spark, monkeypatch):
    monkeypatch.setattr(ed, "CELL_VECTORS", 4)
    monkeypatch.setattr(ed, "QUERIES", 4)
    chance = np.random.default_rng(11)
    rows = ed.unit(chance.normal(size=(6_000, 64)))
    aside = chance.normal(size=(400, 64))
    aside = ed.unit(aside - (aside * rows[:400]).sum(axis=1, keepdims=True) * rows[:400])
    rows = np.concatenate([rows, 0.905 * rows[:400] + np.sqrt(1 - 0.905**2) * aside])
    table = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    assert sum(r.n_links for r in near_duplicates(table, 0.9).collect()) >= 0.97 * 800


@pytest.mark.parametrize("block", [2_048, 64])
def test_vectors_of_each_length_are_compared(spark, monkeypatch, block):
    """Three lengths, of which none, or the two common ones, have an index; equal beginnings of different lengths are no links."""
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "CELL_VECTORS", 8)
    rows = made(200, 3, 20)
    rows += [(2_000 + n, v[:7]) for n, (_, v) in enumerate(rows[:150])] + [(3_000, [1.0, 2.0]), (3_001, [1.0, 2.0]), (3_002, [2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert collected(near_duplicates(table, 0.9, recall=1.0)) == brute(rows, 0.9)
