from __future__ import annotations

import random

from pyspark.sql import functions as F

from epitrove.llm import components as components_module
from epitrove.llm.components import components


def brute(links):
    label = {n: n for link in links for n in link if None not in link and link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_components_are_those_of_the_graph(spark):
    chance = random.Random(4)
    links = [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (-7, 3)]
    links += [(1_000 + n, 1_001 + n) for n in range(20)] + [(2_001 + n, 2_000 + n) for n in reversed(range(20))]
    links += [(3_500, 3_000 + n) for n in range(200)]
    links += [(4_000 + chance.randrange(300), 4_000 + chance.randrange(300)) for _ in range(200)]
    rows = [tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(rows) == len(dict(rows))
    assert dict(rows) == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_the_links_of_a_hub_are_split(spark, monkeypatch):
    """With low thresholds Spark splits the join of a hub's links with its minimum, as both sides come from a shuffle."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000"}
    before = {name: spark.conf.get(name, None) for name in settings}
    plans, pinned = [], components_module.pin

    def watched(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pinned(df)

    for name, value in settings.items():
        spark.conf.set(name, value)
    monkeypatch.setattr(components_module, "pin", watched)
    try:
        hub = spark.range(1, 6_001, 1, 6).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        rest = spark.range(0, 6_000, 1, 6).select((F.col("id") * 2 + 10_000).alias("a"), (F.col("id") * 2 + 10_001).alias("b"))
        chain = spark.createDataFrame([(0, 20_001), (20_001, 20_002), (20_002, 20_003)], "a long, b long")
        found = components(hub.unionByName(rest).unionByName(chain))
        assert found.where("component = 0").count() >= 6_001
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert any("skew=true" in plan for plan in plans)
