from __future__ import annotations

import random
import uuid
from pathlib import Path

import pytest
from conftest import rows

from epitrove.operators.predictions import merge_predictions
from epitrove.plans.storage import scratch_path
from epitrove.sources.pair_store import create_store, merge_into_store, merged_slots, read_store

SCHEMA = "allele string, peptide string, line int, el double"


@pytest.fixture
def store(spark):
    name = f"store_{uuid.uuid4().hex}"
    yield name, scratch_path(spark, "store")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def some(dice, count, lines):
    return [(dice.choice("AB"), f"P{dice.randrange(60)}", n, float(dice.randint(0, 99))) for n in dice.sample(range(lines), count)]


def test_merging_equals_the_plain_merge(spark, store):
    dice = random.Random(5)
    cached = spark.createDataFrame(some(dice, 200, 1_000) + [(None, "P1", 1, 1.0), ("A", None, 2, 2.0)], SCHEMA)
    stored = create_store(cached, *store, ["line"], buckets=4, slots=8)
    expected = merge_predictions(cached.dropna(), cached.limit(0), ["line"])
    assert rows(stored) == rows(expected)
    for n in (1, 40):
        fresh = spark.createDataFrame(some(dice, n, 500), SCHEMA)
        expected = merge_predictions(spark.createDataFrame(expected.collect(), SCHEMA), fresh, ["line"])
        assert rows(merge_into_store(spark, store[0], fresh, ["line"])) == rows(expected)
    assert rows(merge_into_store(spark, store[0], fresh.limit(0), ["line"])) == rows(expected)


def test_stored_rows_are_not_shuffled(spark, store):
    dice = random.Random(6)
    create_store(spark.createDataFrame(some(dice, 300, 1_000), SCHEMA), *store, ["line"], buckets=8, slots=4)
    merged = merged_slots(spark, store[0], spark.createDataFrame(some(dice, 20, 500), SCHEMA), ["line"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    stored, fresh = plan.split("SortMergeJoin")[1].split("FileScan parquet", 1) if plan.index("FileScan") < plan.index("Scan ExistingRDD") else ("Exchange", "")
    assert "Exchange" not in stored and "Exchange" in fresh


def test_only_touched_slots_are_replaced(spark, store):
    pairs = [("A", f"P{n}", n, 1.0) for n in range(100)]
    create_store(spark.createDataFrame(pairs, SCHEMA), *store, ["line"], buckets=2, slots=16)
    before = {p: p.stat().st_mtime_ns for p in Path(store[1]).rglob("*.parquet")}
    merge_into_store(spark, store[0], spark.createDataFrame([("A", "P7", 1, 5.0)], SCHEMA), ["line"])
    after = {p: p.stat().st_mtime_ns for p in Path(store[1]).rglob("*.parquet")}
    gone = {p.parent.name for p in before.keys() - after.keys()}
    assert len(gone) == 1 and {p.parent.name for p in after.keys() - before.keys()} == gone
    assert all(after[p] == before[p] for p in before.keys() & after.keys())
    assert {r.peptide: r.el for r in read_store(spark, store[0]).collect()} == {f"P{n}": 5.0 if n == 7 else 1.0 for n in range(100)}
