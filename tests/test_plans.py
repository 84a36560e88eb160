from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epitrove.operators.predictions import restrict_predictions
from epitrove.operators.tallies import annotate_predictions
from epitrove.plans.joins import lookup_join
from epitrove.plans.numbering import number_rows, number_rows_within
from epitrove.plans.storage import scratch_path, shared_folder


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one key, and many of them are equal."""
    return spark.range(0, 2000, 1, 6).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("k"), (F.col("id") % 5).alias("v")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_lookups_equal_the_plain_join_with_a_hot_key(spark, skewed, how, threshold):
    lookup = spark.createDataFrame([(k, f"n{k}") for k in range(0, 40, 3)] + [(7, "seven"), (7, "again")], "k int, name string")
    plain = rows(skewed.join(lookup, ["k"], how))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert rows(lookup_join(skewed, lookup, "k", how)) == plain
        assert rows(lookup_join(skewed, lookup, ["k"], how, at_most=14)) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookups_refuse_joins_that_add_rows(skewed):
    with pytest.raises(ValueError):
        lookup_join(skewed, skewed, ["k"], "full")


def test_planning_starts_no_job(spark, skewed):
    work = skewed.select(F.col("k").cast("string").alias("peptide"))
    predictions = work.select(F.lit("A").alias("allele"), "peptide", F.lit(1.0).alias("netmhcpan_el_percentile"), F.lit(1.0).alias("netmhcpan_ba_percentile"))
    tallies = work.select(F.lit(1).alias("start"), F.lit(9).alias("len"), "peptide", *[
        F.lit(1).cast("bigint").alias(c) for c in ("frequency_all", "total_all", "frequency_unique", "total_unique")])
    roots = work.select("peptide", F.col("peptide").alias("root"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job expected")
    restrict_predictions(predictions, work, ["A"])
    annotate_predictions(predictions, tallies, roots, "M1")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_numbers_are_gap_free_and_ordered(spark):
    table = spark.range(0, 3000, 1, 7).select((F.col("id") * 7919 % 3001).alias("key"))
    numbered = number_rows(table, ["key"]).orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(1, 3001))
    assert [r["key"] for r in numbered] == sorted(r["key"] for r in numbered)


def test_numbers_within_a_hot_key(spark, skewed):
    table = skewed.withColumn("id", F.monotonically_increasing_id())
    numbered = number_rows_within(table, ["k"], ["id"]).orderBy("k", "id").collect()
    seen = {}
    for row in numbered:
        seen[row["k"]] = seen.get(row["k"], 0) + 1
        assert row["n"] == seen[row["k"]]


def test_scratch_paths_lie_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark) + "/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
