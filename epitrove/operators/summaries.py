"""Summary tables over annotated predictions and isolates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epitrove.operators.filters import filter_root_rows
from epitrove.plans.joins import lookup_join

# The binder bound, the histogram's bins, the rows of the protein report.
BINDER_PERCENTILE = 2.0
BIN_COUNT = 20
BIN_STEP = 0.05
TOP_PROTEINS = 20


def _binds(limit: float) -> Column:
    """A missing percentile is no binder."""
    return F.coalesce(F.col("netmhcpan_el_percentile") <= limit, F.lit(False))


def binders_per_peptide(annotated: DataFrame, limit: float = BINDER_PERCENTILE) -> DataFrame:
    """Per uploaded peptide the alleles that bind it, the alleles tested, and its share."""
    return filter_root_rows(annotated).groupBy("protein", "peptide").agg(
        F.min_by("proportion_all", "allele").alias("proportion_all"),
        F.count_if(_binds(limit)).alias("binders"),
        F.count_distinct("allele").alias("alleles"),
    )


def qualifying_root_join(annotated: DataFrame, limit: float = BINDER_PERCENTILE) -> DataFrame:
    """Binding rows, once per root, whose root itself binds the same allele; a root listed twice counts twice."""
    roots = F.filter(F.transform(F.split("root", ";"), lambda r: F.trim(r)), lambda r: r != "")
    bound = annotated.where(_binds(limit))
    exploded = bound.withColumn("one_root", F.explode(roots))
    qualifying = filter_root_rows(bound).select("protein", F.col("peptide").alias("one_root"), "allele").distinct()
    return lookup_join(exploded, qualifying, ["protein", "one_root", "allele"], "left_semi")


def windows_score(annotated: DataFrame, limit: float = BINDER_PERCENTILE) -> DataFrame:
    """Per root: the summed shares, number and distinct alleles of its qualifying rows."""
    return qualifying_root_join(annotated, limit).groupBy("protein", F.col("one_root").alias("peptide")).agg(
        F.sum(F.coalesce("proportion_all", F.lit(0.0))).alias("score"),
        F.count(F.lit(1)).alias("count"),
        F.count_distinct("allele").alias("allele_count"),
    )


def proportion_histogram(rows: DataFrame, unique: bool = False) -> DataFrame:
    """Rows per share bin and protein. A bin holds its lower edge; the last one also holds 1.

    The bin is the number of edges not above the value: dividing by the step would misplace
    values that sit on an edge.
    """
    value = F.col("proportion_unique" if unique else "proportion_all")
    inside = rows.where(value.between(0, 1))
    bin_no = sum((value >= F.lit(i * BIN_STEP)).cast("int") for i in range(1, BIN_COUNT))
    return inside.groupBy(bin_no.alias("bin"), F.coalesce("protein", F.lit("Unknown")).alias("protein")).agg(
        F.count(F.lit(1)).alias("n")
    )


def protein_row_counts(isolates: DataFrame, top: int = TOP_PROTEINS) -> DataFrame:
    """The proteins with most rows, and the number of proteins beside them."""
    counted = isolates.where(F.col("protein").isNotNull()).groupBy("protein").agg(F.count(F.lit(1)).alias("rows"))
    proteins = counted.agg(F.count(F.lit(1))).scalar()
    return counted.orderBy(F.desc("rows"), "protein").limit(top).withColumn("proteins", proteins)
