"""Residue frequencies by alignment position, over all and over distinct sequences.

Identical sequences are grouped once and carry their number of copies: a count over all
sequences is then a sum of copies, a count over distinct ones a count of groups. One scan and
one pass over the letters answer both, and a sequence that fills a third of the table is
reduced to one row before its letters are taken apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from epitrove.functions.text import letters
from epitrove.operators.filters import IsolateFilter, filter_isolates, isolate_predicate, select_facet

# Fixed value: facet levels shown at once.
MAX_FACETS = 6


def distinct_sequences(isolates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each sequence once per group with its number of ``copies``; missing sequences are left out."""
    known = isolates.where(F.col("sequence").isNotNull())
    return known.groupBy(*by, "sequence").agg(F.count(F.lit(1)).alias("copies"))


def explode_positions(sequences: DataFrame, carried: Sequence[str] = ("sequence",)) -> DataFrame:
    """One row per letter: 1-based ``position`` and ``aminoacid``."""
    filled = sequences.where(F.length("sequence") > 0)
    exploded = filled.select(*carried, F.posexplode(letters(F.col("sequence"))).alias("at", "aminoacid"))
    return exploded.select(*carried, (F.col("at") + 1).alias("position"), "aminoacid")


def left_join_totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals and shares beside counts: a position has few residues, so a window over it is small."""
    group = Window.partitionBy(*by)
    totals = counts.withColumns({
        "total_all": F.sum("frequency_all").over(group),
        "total_unique": F.sum("frequency_unique").over(group),
    })
    return totals.withColumns({
        "value": F.col("frequency_all").cast("double") / F.col("total_all"),
        "value_unique": F.col("frequency_unique").cast("double") / F.col("total_unique"),
    })


def position_frequencies(isolates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, total and share of every residue at every position, per group of ``by`` columns."""
    keys = [*by, "position"]
    cells = explode_positions(distinct_sequences(isolates, by), [*by, "copies"])
    counts = cells.groupBy(*keys, "aminoacid").agg(
        F.sum("copies").alias("frequency_all"), F.count(F.lit(1)).alias("frequency_unique")
    )
    return left_join_totals(counts, keys).select(
        *keys, "aminoacid", "frequency_all", "total_all", "value",
        "frequency_unique", "total_unique", "value_unique",
    )


def position_frequencies_fast(isolates: DataFrame, stored: DataFrame, wanted: IsolateFilter) -> DataFrame:
    """Position frequencies of one protein, from the stored table when no other filter is set."""
    if wanted.has_only_protein():
        live_columns = ("position", "aminoacid", "frequency_all", "total_all", "value",
                        "frequency_unique", "total_unique", "value_unique")
        return stored.where(F.col("protein") == wanted.protein).select(*live_columns)
    return position_frequencies(filter_isolates(isolates, wanted))


def build_position_table(isolates: DataFrame, path: str) -> None:
    """Store the frequencies of every protein, one folder per protein."""
    table = position_frequencies(isolates, ["protein"])
    table.hint("rebalance", F.col("protein")).write.mode("overwrite").partitionBy("protein").parquet(path)


def ordered_positions(frequencies: DataFrame) -> DataFrame:
    return frequencies.orderBy("position", "aminoacid")


def load_profile(stored: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Residue → share map for every position from 1 to the last; unseen positions have empty maps.

    A repeated residue keeps its last row by ``order`` (else its largest share).
    """
    last = F.max_by("value", F.struct(*order)) if order else F.max("value")
    once = stored.groupBy("protein", "position", "aminoacid").agg(last.alias("value"))
    seen = once.groupBy("protein", "position").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("aminoacid", "value")))).alias("shares")
    )
    ends = stored.groupBy("protein").agg(F.max("position").alias("last"))
    every = ends.select("protein", F.explode(F.sequence(F.lit(1), "last")).alias("position"))
    empty = F.create_map().cast("map<string,double>")
    return every.join(seen, ["protein", "position"], "left").withColumn("shares", F.coalesce("shares", empty))


def _by_share(metric: str) -> list[Column]:
    return [F.desc(metric), F.asc("aminoacid")]


def residue_ranking(frequencies: DataFrame, metric: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Residues of a position by share, ties in letter order."""
    position = Window.partitionBy(*by, "position").orderBy(*_by_share(metric))
    return frequencies.select(
        *by, "position", "aminoacid", F.col(metric).alias("value"), F.row_number().over(position).alias("rank")
    )


def conservation_series(frequencies: DataFrame, metric: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Highest share of each position and its residue."""
    return residue_ranking(frequencies, metric, by).where("rank = 1").select(*by, "position", "value", "aminoacid")


def consensus(frequencies: DataFrame, metric: str = "value", by: Sequence[str] = ()) -> DataFrame:
    return conservation_series(frequencies, metric, by).select(*by, "position", "aminoacid")


def diversity_stack(frequencies: DataFrame, metric: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Stacked intervals of the residues below the maximum; all residues at the maximum drop out."""
    position = Window.partitionBy(*by, "position")
    below = frequencies.withColumn("top", F.max(metric).over(position)).where(F.col(metric) != F.col("top"))
    ranked = position.orderBy(*_by_share(metric))
    upward = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = ranked.rowsBetween(Window.unboundedPreceding, -1)
    return below.select(
        *by, "position", "aminoacid",
        F.coalesce(F.sum(metric).over(under), F.lit(0.0)).alias("y0"),
        F.sum(metric).over(upward).alias("y1"),
    )


def sequence_totals(frequencies: DataFrame) -> DataFrame:
    """Numbers of all and of distinct sequences, as the totals of the first position."""
    return frequencies.where("position = 1").agg(
        F.coalesce(F.max("total_all"), F.lit(0)).alias("total_all"),
        F.coalesce(F.max("total_unique"), F.lit(0)).alias("total_unique"),
    )


def metric_delta(isolates: DataFrame, before: IsolateFilter, after: IsolateFilter) -> DataFrame:
    """Sequence totals under two filters and their differences, from one scan."""
    flags = isolates.where("length(sequence) > 0").select(
        "sequence",
        F.coalesce(isolate_predicate(before), F.lit(False)).cast("long").alias("old"),
        F.coalesce(isolate_predicate(after), F.lit(False)).cast("long").alias("new"),
    )
    grouped = flags.where("old + new > 0").groupBy("sequence").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    totals = grouped.agg(*[
        F.coalesce(measure, F.lit(0)).alias(name)
        for name, measure in {
            "total_all_previous": F.sum("old"),
            "total_all_current": F.sum("new"),
            "total_unique_previous": F.count_if(F.col("old") > 0),
            "total_unique_current": F.count_if(F.col("new") > 0),
        }.items()
    ])
    return totals.withColumns({
        f"{m}_delta": F.col(f"{m}_current") - F.col(f"{m}_previous") for m in ("total_all", "total_unique")
    })


def top_facets(weighted: DataFrame, unique: bool = False, most: int = MAX_FACETS) -> DataFrame:
    """The busiest facet levels; equal counts go by name. A missing level can take a place."""
    rows = F.count(F.lit(1)) if unique else F.sum("copies")
    counted = weighted.groupBy("facet").agg(rows.alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_last("facet")).limit(most)


def join_top_facets(weighted: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of the top levels; ``top`` has at most a handful of rows. The missing level drops out."""
    return weighted.join(F.broadcast(top.select("facet")), "facet", "left_semi")


def rank_facet_residue(counts: DataFrame) -> DataFrame:
    """Residues of each facet and position by share, ties in letter order."""
    group = Window.partitionBy("facet", "position")
    shares = counts.withColumn("total", F.sum("frequency").over(group)).withColumn(
        "share", F.col("frequency").cast("double") / F.col("total")
    )
    return shares.withColumn("r", F.row_number().over(group.orderBy(F.desc("share"), "aminoacid")))


def facet_counts(isolates: DataFrame, facet: str, unique: bool = False, most: int = MAX_FACETS) -> DataFrame:
    """Residue counts by facet level and position; only the top levels are taken apart."""
    weighted = distinct_sequences(select_facet(isolates, facet), ["facet"])
    kept = join_top_facets(weighted, top_facets(weighted, unique, most))
    cells = explode_positions(kept, ["facet", "copies"])
    rows = F.count(F.lit(1)) if unique else F.sum("copies")
    return cells.groupBy("facet", "position", "aminoacid").agg(rows.alias("frequency"))


def facet_conservation(isolates: DataFrame, facet: str, unique: bool = False, most: int = MAX_FACETS) -> DataFrame:
    """Top residue of every position for each of the busiest facet levels."""
    ranked = rank_facet_residue(facet_counts(isolates, facet, unique, most)).where("r = 1")
    missing = F.lit(None).cast("double")
    return ranked.select(
        "facet", "position", "aminoacid", "frequency", "total",
        (missing if unique else F.col("share")).alias("value"),
        (F.col("share") if unique else missing).alias("value_unique"),
    )


def compare_reference_consensus(reference: DataFrame, agreed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reference and consensus letter of each position, whether they match and whether both are gaps.

    ``reference`` holds aligned sequences; a position that only one side has is a mismatch.
    """
    cells = explode_positions(
        reference.withColumnRenamed("aligned_sequence", "sequence"), list(by)
    ).withColumnRenamed("aminoacid", "reference")
    both = cells.join(agreed.withColumnRenamed("aminoacid", "consensus"), [*by, "position"], "full")
    return both.select(
        *by, "position", "reference", "consensus",
        F.coalesce(F.col("reference") == F.col("consensus"), F.lit(False)).alias("is_match"),
        F.coalesce((F.col("reference") == "-") & (F.col("consensus") == "-"), F.lit(False)).alias("both_gap"),
    )
