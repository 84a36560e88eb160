from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import collected, odd_documents, some_documents, table  # noqa: F401

from epitrove.llm import minhash
from epitrove.llm.minhash import near_duplicates, one_of_each, open_buckets, overlaps, second_pass, shingle_sets, signatures


def sets_of(documents, size):
    out = {}
    for doc_id, text in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        held = {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        out.setdefault(doc_id, []).append(held)
    return out


def brute(documents, size, percent):
    sets = sets_of(documents, size)
    ids = [i for i in sets if i is not None]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if label[a] != label[b] and any(near(x, y) for x in sets[a] for y in sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    rows = []
    for doc_id, held in sets.items():
        rows += [(doc_id, len(h), label.get(doc_id), doc_id is None or label[doc_id] == doc_id) for h in held]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80), (1, 50)])
def test_equals_brute_force(table, some_documents, size, percent):
    assert collected(near_duplicates(table(some_documents), size, percent)) == brute(some_documents, size, percent)


def test_odd_documents(table, odd_documents):
    assert collected(near_duplicates(table(odd_documents), 3, 85)) == brute(odd_documents, 3, 85)


def family(count, edits, seed=2):
    """Near copies of one text: many links, and many that miss them narrowly."""
    chance = random.Random(seed)
    base = [f"w{n}" for n in range(120)]
    out = []
    for n in range(count):
        words = list(base)
        for _ in range(chance.randint(0, edits)):
            words[chance.randrange(len(words))] = f"x{chance.randrange(50)}"
        out.append((n, " ".join(words)))
    return out


@pytest.mark.parametrize("edits", [4, 10])
def test_a_family_larger_than_a_block(table, monkeypatch, edits):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "ANCHORS", 3)
    documents = family(120, edits)
    assert collected(near_duplicates(table(documents), 3, 85)) == brute(documents, 3, 85)


def test_blocks_are_bounded_by_bytes_too(table, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2_000)
    documents = family(60, 8) + [(100, " ".join(f"w{n}" for n in range(3_000))), (101, " ".join(f"w{n}" for n in range(2_990)))]
    assert collected(near_duplicates(table(documents), 3, 85)) == brute(documents, 3, 85)


def test_a_chain_of_related_documents_that_are_not_linked(table, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "ANCHORS", 2)
    step = lambda n: 5 if n % 10 == 9 else 14
    starts = [sum(map(step, range(n))) for n in range(60)]
    documents = [(n, " ".join(f"w{k}" for k in range(at, at + 120))) for n, at in enumerate(starts)]
    expected = brute(documents, 3, 85)
    assert 1 < len({r[2] for r in expected}) < len(expected)
    assert collected(near_duplicates(table(documents), 3, 85)) == expected


def test_the_second_pass_grows_with_buckets_not_with_pairs_of_a_family(spark):
    """20,000 unlinked documents of one family: each shares buckets with its neighbours only."""
    chain = spark.range(20_000).selectExpr("explode(array(2 * id, 2 * id + 1, 2 * id + 2)) AS bucket", "id AS node", "1000L AS n_bytes", "id AS component")
    buckets = open_buckets(chain)
    assert buckets.selectExpr("count(*)", "max(n)", "max(blocks)").first() == (19_999, 2, 1)
    placed = second_pass(chain, buckets)
    assert placed.count() == 2 * 19_999
    assert placed.groupBy("bundle").count().selectExpr("max(count)").first()[0] < 3 * minhash.BLOCK


def test_buckets_with_the_same_members_or_one_component_are_compared_once_or_never(spark):
    rows = [(b, n, 10, n) for b in (1, 2, 3) for n in (7, 8)] + [(4, n, 10, 5) for n in (7, 8, 9)] + [(5, n, 10, n) for n in (7, 9)]
    found = open_buckets(spark.createDataFrame(rows, "bucket long, node long, n_bytes long, component long"))
    assert collected(found.select("bucket", "n", "size")) == [(1, 2, 20), (5, 2, 20)]


def test_a_large_bucket_meets_block_by_block(spark, monkeypatch):
    """All pairs of different components come together in some bundle; one large component isn't compared with itself."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    shared = spark.createDataFrame([(1, n, 10, 0 if n < 12 else n) for n in range(24)], "bucket long, node long, n_bytes long, component long")
    bundles = {}
    for row in second_pass(shared, open_buckets(shared)).collect():
        bundles.setdefault(row.bundle, set()).add(row.node)
    together = {(a, b) for held in bundles.values() for a in held for b in held if a < b}
    assert {(a, b) for a in range(24) for b in range(max(a + 1, 12), 24)} <= together
    assert not any(max(held) < 12 for held in bundles.values())


def test_empty_table_and_clashing_columns(table):
    assert near_duplicates(table([])).collect() == []
    docs = table([(1, "a b c d"), (2, "A b C d"), (3, "a")], "node long, bands string, bucket int, component_id long, kept string", (1, "b", 2, 3, "k"))
    assert collected(near_duplicates(docs, 3, 85)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True)]


def test_one_of_each_keeps_the_columns_and_one_row_per_id(table, odd_documents):
    docs = table(odd_documents)
    kept = one_of_each(docs, 3, 85)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({i for i, _, c, k in brute(odd_documents, 3, 85) if i is not None and k})
    assert kept.where("doc_id is null").count() == 2


def test_bins_without_hashes_borrow_from_full_ones():
    hashes, bounds = shingle_sets(pa.array(["a b c", "a b c d e f", "", "a b c"]), 3)
    found = signatures(hashes, bounds)
    assert (found[0] == found[3]).all() and (found[2] == 0).all()
    assert set(found[1].tolist()) <= set(hashes[bounds[1]:bounds[2]].tolist()) and len(set(found[1].tolist())) == 4


def test_overlaps_counts_common_members():
    sets = [{1, 2, 3}, {2, 3, 4}, set(), {9}, {1, 2, 3}]
    hashes = np.array([h for s in sets for h in sorted(s)], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found = overlaps(hashes, bounds)
    assert all(found[a, b] == len(sets[a] & sets[b]) for a in range(5) for b in range(5) if a != b)


def test_different_words_of_equal_polynomials_are_no_near_duplicates(table):
    from test_words import morse

    found = near_duplicates(table(list(enumerate(morse(1_024)))), size=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(0, 0, True), (1, 1, True)]
