from __future__ import annotations

import random

import numpy as np
import pytest
from llm_fixtures import odd_documents, table  # noqa: F401

from epitrove.llm import periodic_runs
from epitrove.llm.periodic_runs import collapse_runs, octaves, solve, word_ids


def brute(words, least):
    """(start, length, period) of every run, period by period."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            start = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            if at - start + period >= max(least, 2 * period):
                found.setdefault((start, at - start + period), period)
            at += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(dice, most=300):
    """Words of a small vocabulary, of which some stretches repeat with a period."""
    words = [f"w{dice.randrange(dice.choice([1, 2, 4, 60]))}" for _ in range(dice.randint(0, most))]
    for _ in range(dice.randint(0, 3) if len(words) > 3 else 0):
        start = dice.randrange(len(words))
        end, period = dice.randint(start, len(words)), dice.randint(1, max(1, (len(words) - start) // 2))
        for i in range(start + period, end):
            words[i] = words[i - period]
    return words


def answers(frame):
    return sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in frame.collect())


@pytest.mark.parametrize("least", [12, 4, 1])
def test_tiles_of_many_documents_equal_brute_force(least):
    dice = random.Random(least)
    for _ in range(60):
        docs = [periodic(dice) for _ in range(dice.randint(1, 4))]
        ids = word_ids([" ".join(d).encode() for d in docs])
        bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        parts = solve(np.concatenate(ids), bounds, octaves(least, max(map(len, ids))), 0, int(bounds[-1]))
        for n, words in enumerate(docs):
            found = {}
            for period, start, end in zip(*parts):
                if bounds[n] <= start < bounds[n + 1] and end - start >= max(period, least - period):
                    key = (int(start - bounds[n]), int(end - start + period))
                    found[key] = min(found.get(key, period), int(period))
            assert sorted((s, c, p) for (s, c), p in found.items()) == brute(words, least)


@pytest.mark.parametrize("long_bytes,bundle", [(4_000_000, 65_536), (0, 16), (200, 64)])
def test_equals_brute_force(table, monkeypatch, long_bytes, bundle):
    """Also with every document, or the longer ones, dealt out in bundles of tiles and stitched."""
    monkeypatch.setattr(periodic_runs, "LONG_BYTES", long_bytes)
    monkeypatch.setattr(periodic_runs, "BUNDLE_WORDS", bundle)
    dice = random.Random(7)
    docs = {n: periodic(dice) for n in range(40)}
    found = collapse_runs(table([(n, " ".join(w)) for n, w in docs.items()])).select("doc_id", "n_words", "runs", "kept_text")
    assert answers(found) == [(n, len(w), brute(w, 12), collapsed(w, brute(w, 12))) for n, w in docs.items()]


def test_odd_documents(table, odd_documents):
    import re

    expected = []
    for doc_id, text in odd_documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        expected.append((doc_id, len(words), brute(words, 12) if len(words) < 2_000 else [(0, len(words), 2)], collapsed(words, brute(words, 12) if len(words) < 2_000 else [(0, len(words), 2)])))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in collapse_runs(table(odd_documents)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_empty_table(table):
    assert collapse_runs(table([])).collect() == []


def test_clashing_columns_come_along(table):
    docs = table([(1, "a " * 20)], "key string, runs int, period long, row string", ("k", 5, 6, "r"))
    row = collapse_runs(docs).collect()[0]
    assert [tuple(x) for x in row.runs] == [(0, 20, 1)] and row.kept_text == "a"
    assert (row.row.key, row.row.runs, row.row.period, row.row.row, row.row.lang) == ("k", 5, 6, "r", "en")


def test_a_text_longer_than_one_task_solves(table):
    """Five million bytes: fresh words, then a period of 100,000 words to the end, and one word many times before."""
    fresh = [f"x{n}" for n in range(200_000)]
    words = ["again"] * 50_000 + fresh + fresh[-100_000:] * 4
    assert len(" ".join(words)) > periodic_runs.LONG_BYTES
    row = collapse_runs(table([(1, " ".join(words)), (2, "b " * 12)])).where("doc_id = 1").collect()[0]
    assert [tuple(r) for r in row.runs] == [(0, 50_000, 1), (150_000, 500_000, 100_000)]
    assert row.n_words == 650_000 and len(row.kept_text.split()) == 1 + 200_000
