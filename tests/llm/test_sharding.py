from __future__ import annotations

import zlib
from hashlib import md5

import pytest
from llm_fixtures import collected, odd_documents, some_documents, table  # noqa: F401

from epitrove.llm.sharding import shards


def brute(documents, count):
    rows = sorted(((md5((t or "").encode()).hexdigest(), i is not None, i or 0, i, t or "") for i, t in documents))
    total, start, out, slots = sum(len(r[4].encode()) + 1 for r in rows), 0, [], {}
    for *_, doc_id, text in rows:
        size = len(text.encode()) + 1
        shard = (2 * start + size) * count // (2 * total)
        out.append((doc_id, size, zlib.crc32(text.encode()), "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        start += size
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("count", [16, 3])
def test_shards_are_cut_at_equal_bytes(table, some_documents, count):
    found = collected(shards(table(some_documents), count))
    assert found == brute(some_documents, count)
    sizes = [sum(r[1] for r in found if r[4] == n) for n in range(count)]
    longest = max(r[1] for r in found)
    assert max(sizes) - min(sizes) <= 2 * longest


def test_odd_documents(table, odd_documents):
    assert collected(shards(table(odd_documents), 4)) == brute(odd_documents, 4)


def test_empty_table_and_clashing_columns(table):
    assert shards(table([])).collect() == []
    docs = table([(1, "a"), (2, "b")], "size long, start string, shard int, number long", (1, "s", 2, 3))
    assert collected(shards(docs, 2)) == brute([(1, "a"), (2, "b")], 2)


def test_the_plan_has_no_python(table, some_documents):
    plan = shards(table(some_documents))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
