from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from llm_fixtures import odd_documents, some_documents, table  # noqa: F401
from pyspark.sql import functions as F

from epitrove.llm import packing
from epitrove.llm.packing import Encoder, best_fit, cut, pack, pack_by_place
from epitrove.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def ids_of(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_looked_up_ids_are_those_of_the_tokenizer(encoder, some_documents):
    assert encoder.plain
    chance = random.Random(3)
    signs = [" ", "  ", "\n", "\t", "\u3000", " a", "b", "é", "'s", "!!", "12", "\r\n", "<|endoftext|>", "\u00a0", "\x1c", "\x85", "'", "ll", " dé", "日本"]
    texts = [t for _, t in some_documents] + ["".join(chance.choice(signs) for _ in range(chance.randint(0, 9))) for _ in range(4_000)]
    for text, found in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(found, "<u4").tolist() == ids_of(encoder, text), repr(text)


def test_a_full_memory_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    texts = ["one two three four", "five six one", "two two"]
    assert encoder.encode(texts) == encoder.encode(texts)


@pytest.mark.parametrize("length, pieces", [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (30, [(0, 10), (10, 10), (20, 10)])])
def test_cut(length, pieces):
    assert cut(length, 10) == pieces


@pytest.mark.parametrize("open_bins", [1, 4, 256])
def test_best_fit_fills_without_gaps(open_bins):
    chance = random.Random(open_bins)
    lengths = [chance.choice([1, 2, 7, 50, 99, 100]) for _ in range(2_000)]
    sequence, offset = best_fit(lengths, 100, open_bins)
    filled = {}
    for s, o, n in zip(sequence, offset, lengths):
        assert filled.get(s, 0) == o and o + n <= 100
        filled[s] = o + n
    assert len(filled) <= 2 * -(-sum(lengths) // 100)


def test_best_fit_takes_the_fullest_bin_that_fits():
    assert best_fit([60, 70, 30, 40], 100, 8) == ([0, 1, 1, 0], [0, 0, 70, 60])
    # With one open bin the fuller of the two is closed.
    assert best_fit([60, 70, 30, 40], 100, 1) == ([0, 1, 0, 2], [0, 0, 60, 0])


def placed(frame):
    return [r.asDict() for r in frame.collect()]


def check_packed(encoder, documents, rows, most):
    texts = {}
    for doc_id, text in documents:
        texts.setdefault(doc_id, []).append(text or "")
    for doc_id, own in texts.items():
        mine = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: (r["piece"], r["start"]))
        expected = []
        for text in own:
            ids = np.array([*ids_of(encoder, text), 0], "<u4").tobytes()
            expected += [(n, s, k, zlib.crc32(ids[4 * s:4 * (s + k)])) for n, (s, k) in enumerate(cut(len(ids) // 4, most))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in mine) == sorted(expected)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= most
    return len(bins)


@pytest.mark.parametrize("group", [20_000, 40])
def test_every_piece_has_its_place(table, encoder, some_documents, group):
    rows = placed(pack(table(some_documents, parts=5), tokenizer_path(), 256, group_pieces=group))
    bins = check_packed(encoder, some_documents, rows, 256)
    if group > len(rows):
        assert bins <= 1.05 * sum(r["length"] for r in rows) / 256 + 1


def test_odd_documents(table, encoder, odd_documents):
    rows = placed(pack(table(odd_documents), tokenizer_path(), 128))
    check_packed(encoder, odd_documents, rows, 128)


def test_empty_table_and_clashing_columns(table, encoder):
    assert pack(table([]), tokenizer_path()).collect() == []
    docs = table([(1, "a b"), (2, "c")], "part int, doc long, piece string, offset int, bundle long", (1, 2, "p", 3, 4))
    check_packed(encoder, [(1, "a b"), (2, "c")], placed(pack(docs, tokenizer_path())), 2048)


@pytest.mark.parametrize("group", [20_000, 40])
def test_groups_follow_the_places(table, encoder, some_documents, odd_documents, group):
    documents = some_documents + odd_documents
    placed_by = lambda pieces: pieces.withColumn("place", F.abs(F.col("doc_id") - 500))
    rows = placed(pack_by_place(table(documents, parts=7), placed_by, tokenizer_path(), 256, group_pieces=group))
    check_packed(encoder, documents, rows, 256)
    place = lambda r: 10**9 if r["doc_id"] is None else abs(r["doc_id"] - 500)
    groups = {}
    for r in rows:
        groups.setdefault(r["sequence_id"] >> 32, []).append(place(r))
    assert len(groups) == -(-len(rows) // group) and [n for _, own in sorted(groups.items()) for n in sorted(own)] == sorted(map(place, rows))
    assert max(map(len, groups.values())) - min(map(len, groups.values())) <= 1
    assert pack_by_place(table([]), placed_by, tokenizer_path()).collect() == []


def listed_best_fit(lengths, most, open_bins):
    """The rule with a plain list of open sequences: the least free space that fits, of equal ones the last to get it;
    with too many open, the fullest closes, of equal ones the first to get there."""
    opened, used, out = [], [], []
    for length in lengths:
        fitting = [(free, -n) for n, (free, _) in enumerate(opened) if free >= length]
        if fitting:
            name = opened.pop(-min(fitting)[1])[1]
        else:
            name = len(used)
            used.append(0)
        out.append((name, used[name]))
        used[name] += length
        if used[name] < most:
            opened.append((most - used[name], name))
            if len(opened) > open_bins:
                least = min(free for free, _ in opened)
                # The one that was just filled closes if it is as full as any.
                opened.pop(len(opened) - 1 if opened[-1][0] == least else next(n for n, (free, _) in enumerate(opened) if free == least))
    return [n for n, _ in out], [o for _, o in out]


@pytest.mark.parametrize("open_bins", [1, 3, 16, 256])
def test_bitset_takes_the_bins_of_a_plain_list(open_bins):
    for seed in range(20):
        chance = random.Random(seed)
        kinds = [[1, 2, 7, 50, 99, 100], list(range(1, 101)), [30, 35, 40, 60, 65]][seed % 3]
        lengths = [chance.choice(kinds) for _ in range(500)]
        assert best_fit(lengths, 100, open_bins) == listed_best_fit(lengths, 100, open_bins)
