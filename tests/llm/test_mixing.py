from __future__ import annotations

import random
from fractions import Fraction

import pytest

from epitrove.llm import queries
from epitrove.llm.mixing import OTHERS, in_mix_order, mix, parts_of, phases, schedule


@pytest.mark.parametrize("seed", range(30))
def test_a_source_is_less_than_a_block_off_its_weight(seed):
    chance = random.Random(seed)
    parts = {f"s{k}": chance.randint(1, 60) for k in range(chance.randint(1, 9))}
    order, seen = schedule(parts), dict.fromkeys(parts, 0)
    for slot, name in enumerate(order, 1):
        seen[name] += 1
        assert all(abs(seen[k] - parts[k] * slot / len(order)) < 1 for k in parts)
    assert seen == parts


def simulated(parts, blocks):
    """The mix slot by slot: the earliest due of the released blocks; a new start when a source is used up."""
    left, out = {n: blocks.get(n, 0) for n in parts if blocks.get(n, 0)}, []
    while left:
        total, taken, slot = sum(parts[n] for n in left), dict.fromkeys(left, 0), 0
        while True:
            ready = [(-(-(taken[n] + 1) * total // parts[n]), n) for n in left if taken[n] * total // parts[n] <= slot]
            name = min(ready)[1]
            if taken[name] == left[name]:
                break
            out.append((name, blocks[name] - left[name] + taken[name]))
            taken[name] += 1
            slot += 1
        left = {n: left[n] - taken[n] for n in left if left[n] > taken[n]}
    return out


@pytest.mark.parametrize("seed", range(20))
def test_phases_are_those_of_a_simulation(seed):
    chance = random.Random(seed)
    parts = {f"s{k}": chance.randint(1, 12) for k in range(chance.randint(1, 6))}
    blocks = {n: chance.choice([0, 1, 3, 17, 60]) for n in parts}
    found = {}
    for r in phases(parts, blocks):
        for block in range(r["first"], r["last"]):
            if (block - r["first"]) % r["parts"] == r["turn"]:
                found[r["base"] + (block - r["first"]) // r["parts"] * r["cycle"] + r["slot"]] = (r["source"], block)
    assert [found[n] for n in range(len(found))] == simulated(parts, blocks) and len(found) == sum(blocks.values())


def brute(rows, weights, other, size):
    parts = parts_of({**weights, OTHERS: other})
    by = {}
    for doc_id, source in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        by.setdefault(source if source in weights else OTHERS, []).append(doc_id)
    order = simulated(parts, {n: -(-len(ids) // size) for n, ids in by.items()})
    return [(doc_id, name) for name, block in order for doc_id in by[name][block * size:(block + 1) * size]]


ROWS = [(n, "hot" if n % 3 == 0 else f"s{n % 7}") for n in range(300)] + [(500, None), (501, "it's \\ odd"), (None, "hot"), (None, None), (7, "s0"), (7, "s0")]
WEIGHTS = {"hot": 2.0, "s1": 1.0, "s2": 0.5, "s3": 0.25, "it's \\ odd": 0.1, "absent": 3.0}


@pytest.mark.parametrize("size", [4, 1, 1_000])
def test_the_mix_takes_every_row_once_in_the_order_of_the_schedule(spark, size):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string").repartition(5)
    found = mix(docs, WEIGHTS, 0.5, size).orderBy("mix_position").collect()
    assert [r.mix_position for r in found] == list(range(len(ROWS)))
    assert [(r.doc_id, r.mix_source) for r in found] == brute(ROWS, WEIGHTS, 0.5, size)


def test_empty_table_clashing_columns_and_no_python(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mix(empty, {"a": 1.0}).collect() == []
    docs = spark.createDataFrame([(1, "a", 9, "p"), (2, "b", 8, "q")], "doc_id long, source string, mix_slot int, slot string")
    found = mix(docs, {"a": 1.0})
    assert sorted((r.doc_id, r.slot) for r in found.collect()) == [(1, "p"), (2, "q")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_weights_must_be_positive():
    for wrong in ({}, {"a": 0.0}, {"a": -1.0}):
        with pytest.raises(ValueError):
            parts_of(wrong)


def test_sorted_rows_keep_everything(spark):
    docs = spark.createDataFrame([(i, f"t{n}", s) for n, (i, s) in enumerate(ROWS)], "doc_id long, text string, source string")
    found = in_mix_order(docs, WEIGHTS)
    assert found.columns == docs.columns
    assert sorted(r.text for r in found.collect()) == sorted(f"t{n}" for n in range(len(ROWS)))
    assert [r.doc_id for r in found.collect()][-2:] == [None, None]


@pytest.mark.parametrize("weights", [{**queries.SOURCE_WEIGHTS, OTHERS: 1.0}, queries.SOURCE_WEIGHTS, {"a": 1.0, "b": 0.0001, "c": 0.1}, {"a": 1 / 3, "b": 0.123456789}])
def test_a_source_stays_less_than_a_block_off_the_weight_asked_for(weights):
    exact = {name: Fraction(str(w)) for name, w in weights.items()}
    total = sum(exact.values())
    rows, seen, slots = phases(parts_of(weights), dict.fromkeys(weights, 9_000)), dict.fromkeys(weights, 0), {}
    first = {r["source"]: r["last"] for r in rows if r["base"] == 0}
    for r in rows:
        if r["base"] == 0:
            for block in range(r["turn"], first[r["source"]], r["parts"]):
                slots[block // r["parts"] * r["cycle"] + r["slot"]] = r["source"]
    assert sorted(slots) == list(range(sum(first.values()))) and len(slots) >= 9_000
    for slot in range(len(slots)):
        seen[slots[slot]] += 1
        assert all(abs(seen[name] - w * (slot + 1) / total) < 1 for name, w in exact.items())


def test_rare_weights_are_mixed_as_simulated(spark):
    weights = {"hot": 1.0, "s1": 0.0001, "s2": 0.123456789}
    docs = spark.createDataFrame(ROWS, "doc_id long, source string")
    found = mix(docs, weights, 0.5, 2).orderBy("mix_position").collect()
    assert [(r.doc_id, r.mix_source) for r in found] == brute(ROWS, weights, 0.5, 2)
