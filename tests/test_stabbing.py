from __future__ import annotations

import random

import pytest
from conftest import rows

from epitrove.operators.stabbing import BLOCK, best_interval

SCHEMA = "name string, start int, end int, value double, text string"


def by_hand(intervals):
    best = {}
    for name, start, end, value, text in intervals:
        for position in range(start, end + 1):
            key = (name, position)
            best[key] = min(best.get(key, (9e9, 0, "")), (value, start, text))
    return sorted(((*k, *v) for k, v in best.items()), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("longest,batch", [(9, 10_000), (3 * BLOCK, 10_000), (14, 3)])
def test_best_of_all_intervals_over_each_position(spark, longest, batch):
    dice = random.Random(longest + batch)
    intervals = []
    for _ in range(400):
        start = dice.randint(1, 700)
        intervals.append((dice.choice([None, "a", "b", "hot", "hot", "hot"]), start, start + dice.randrange(longest), float(dice.randint(0, 9)), dice.choice(["x", "y", "é"])))
    intervals += intervals[:50] + [("far", 2_000_000_000, 2_000_000_003, 1.0, "z")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = best_interval(spark.createDataFrame(intervals, SCHEMA).repartition(5), ["name"], ["value", "start", "text"])
        assert rows(found) == by_hand(intervals)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_intervals(spark):
    assert best_interval(spark.createDataFrame([], SCHEMA), ["name"], ["value", "start", "text"]).collect() == []


def test_nothing_is_aggregated_before_the_sweep(spark):
    table = spark.createDataFrame([("a", n, n + 8, 1.0, "x") for n in range(1, 1_001)], SCHEMA)
    found = best_interval(table, ["name"], ["value", "start", "text"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" not in plan
