"""Binding predictions: merge, restrict, overlay and reduce ``(allele, peptide)`` tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from epitrove.functions.schema import (
    LABEL_SEQUENCE_NAMES, peptide_length, percentile_column, percentile_value, quoted, sequence_number,
)
from epitrove.functions.text import allele_key, is_residues_only, peptide_key, ungapped
from epitrove.operators.filters import filter_predictions_slice
from epitrove.operators.stabbing import best_interval
from epitrove.plans.joins import literal_list, lookup_join
from epitrove.sources.pair_store import PAIR, latest_by_pair

PERCENTILES = ("netmhcpan_el_percentile", "netmhcpan_ba_percentile")


def missing_predictions(worklist: DataFrame, alleles: Sequence[str], cached: DataFrame) -> DataFrame:
    """The (allele, peptide) pairs without a cached prediction.

    Each peptide's cached alleles (no more than were asked for) are subtracted from the asked
    ones, so pairs that are present are never built.
    """
    asked = list(dict.fromkeys(alleles))
    have = cached.where(F.upper("allele").isin([a.upper() for a in asked])).groupBy(
        F.upper("peptide").alias("key")
    ).agg(F.collect_set(F.upper("allele")).alias("have"))
    work = worklist.select("peptide").distinct().withColumn("key", F.upper("peptide"))
    held = F.coalesce("have", F.array().cast("array<string>"))
    lacking = F.filter(literal_list(asked), lambda a: ~F.array_contains(held, F.upper(a)))
    return work.join(have, "key", "left").select(F.explode(lacking).alias("allele"), "peptide")


def request_of_missing(missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one request has to cover: alleles that lack anything, and all peptides lacking for any."""
    return missing.select("allele").distinct(), missing.select("peptide").distinct()


def merge_predictions(cached: DataFrame, fresh: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per (allele, peptide): fresh rows replace cached ones, later rows earlier ones.

    ``order`` names the columns that tell later rows; without it the larger percentiles count as
    later. Both tables are shuffled; ``sources.pair_store`` keeps a cache that isn't.
    """
    kept = [c for c in cached.columns if c not in PAIR]
    old = latest_by_pair(cached, order).select(*PAIR, F.struct(*kept).alias("old"))
    new = latest_by_pair(fresh, order).select(*PAIR, F.struct(*kept).alias("new"))
    both = old.join(new, PAIR, "full")
    return both.select(*PAIR, F.coalesce("new", "old").alias("last")).select(*PAIR, "last.*")


def restrict_predictions(predictions: DataFrame, workset: DataFrame, alleles: Sequence[str]) -> DataFrame:
    """Rows whose peptide is in the work set and whose allele is selected."""
    selected = predictions.where(F.upper("allele").isin([a.upper() for a in alleles]))
    wanted = workset.select(F.upper("peptide").alias("__key")).distinct()
    return lookup_join(selected.withColumn("__key", F.upper("peptide")), wanted, "__key", "left_semi").drop("__key")


def predictions_for_peptides(predictions: DataFrame, peptides: DataFrame) -> DataFrame:
    """Rows whose peptide, without white space and gaps, is on the list."""
    def cleaned(name: str) -> Column:
        return F.regexp_replace(F.upper(name), r"[\s-]", "")

    wanted = peptides.select(cleaned("peptide").alias("__key")).where("__key <> ''").distinct()
    return lookup_join(
        predictions.withColumn("__key", cleaned("peptide")), wanted, "__key", "left_semi"
    ).drop("__key")


def _place(rows: DataFrame, order: Sequence[str]) -> Column:
    """What tells later rows: two numbers of 32 bits as one of 64, so that a hash aggregate can hold it, else a struct."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and all(kinds.get(c) in ("byte", "short", "integer") for c in order):
        high, low = (F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 31))) for c in order)
        return F.shiftleft(high, 32) + (low + F.lit(1 << 31))
    return F.struct(*order)


def _by_pair(predictions: DataFrame, allele: Column, wanted: DataFrame, order: Sequence[str]) -> DataFrame:
    """Percentiles by (allele key, peptide key), only for the peptides that are wanted; each row has those of its class.

    Of a pair's rows the last finite value of each percentile counts, by the columns ``order``.
    Without an order pairs must not repeat; if they do, the largest value counts.
    """
    keyed = predictions.select(
        allele.alias("allele_key"), peptide_key(F.col("peptide")).alias("peptide_key"),
        percentile_value(predictions.columns, "EL").alias(PERCENTILES[0]), percentile_value(predictions.columns, "BA").alias(PERCENTILES[1]),
        _place(predictions, order).alias("__order") if order else F.lit(None).alias("__order"),
    )
    needed = lookup_join(keyed, wanted.select("peptide_key").distinct(), "peptide_key", "left_semi")

    def last(name: str) -> Column:
        value = F.col(name)
        finite = F.when(F.abs(value) < F.lit(float("inf")), value)
        return (F.max_by(finite, F.when(finite.isNotNull(), F.col("__order"))) if order else F.max(finite)).alias(name)

    return needed.groupBy("allele_key", "peptide_key").agg(*[last(p) for p in PERCENTILES])


def overlay_percentiles(rows: DataFrame, alleles: Sequence[str], predictions: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Every row with every chosen allele and the pair's percentiles, if known, of class I or II.

    ``order`` names the columns that tell later predictions of a pair; its last finite values count.
    """
    grid = rows.withColumn("peptide_key", peptide_key(F.col("peptide"))).select(
        "*", F.explode(literal_list(alleles)).alias("allele")
    ).withColumn("allele_key", F.trim(F.upper("allele")))
    known = _by_pair(predictions, F.trim(F.upper("allele")), grid, order)
    return lookup_join(grid, known, ["allele_key", "peptide_key"], "left").drop("allele_key", "peptide_key")


def percentile_by_allele_key(
    rows: DataFrame, allele: str, predictions: DataFrame, mode: str = "EL", order: Sequence[str] = ()
) -> DataFrame:
    """Percentile of one allele, however it is spelt, for the uploaded or else the aligned form."""
    metric = PERCENTILES["BA" in mode.upper()]
    forms = rows.withColumns({
        "__upload": peptide_key(F.col("peptide")), "__aligned": peptide_key(F.col("peptide_aligned"))
    })
    wanted = forms.select(F.explode(F.array("__upload", "__aligned")).alias("peptide_key")).where("peptide_key <> ''")
    of_allele = predictions.where(allele_key(F.col("allele")) == allele_key(F.lit(allele)))
    known = _by_pair(of_allele, allele_key(F.col("allele")), wanted, order).where(F.col(metric).isNotNull())
    first = known.select(F.col("peptide_key").alias("__upload"), F.col(metric).alias("__first"))
    second = known.select(F.col("peptide_key").alias("__aligned"), F.col(metric).alias("__second"))
    joined = lookup_join(lookup_join(forms, first, "__upload", "left"), second, "__aligned", "left")
    return joined.withColumn("percentile", F.coalesce("__first", "__second")).drop(
        "__upload", "__aligned", "__first", "__second"
    )


def allele_matrix(predictions: DataFrame, alleles: Sequence[str], metric: str = PERCENTILES[0]) -> DataFrame:
    """Peptides by alleles; cells without a prediction are NULL. Expects merged predictions."""
    chosen = predictions.where(F.col("allele").isin(list(alleles)))
    return chosen.groupBy("peptide").pivot("allele", list(alleles)).agg(F.max(metric)).orderBy("peptide")


def _chosen(predictions: DataFrame, method: str) -> DataFrame:
    column = percentile_column(predictions.columns, method)
    return predictions.select(
        sequence_number(predictions).alias("seq_no"), peptide_length(predictions).alias("peptide_length"),
        "allele", "peptide", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        quoted(column).cast("double").alias("pct"),
    )


def min_percentile_by_position(predictions: DataFrame, method: str) -> DataFrame:
    """Heat map: the lowest percentile over each position and its residue, per sequence and length.

    Ties go to the smaller start, then to the peptide. Predictions are shuffled once, by slice and block of
    positions, and never unfolded to the positions they cover.
    """
    slices = ["seq_no", "peptide_length", "allele"]
    usable = _chosen(predictions, method).where(
        (F.col("allele") != "") & (F.col("peptide") != "") & F.col("start").isNotNull()
        & F.col("end").isNotNull() & F.col("pct").isNotNull() & ~F.isnan("pct") & (F.col("start") <= F.col("end"))
    )
    best = best_interval(usable, slices, ["pct", "start", "peptide"])
    return best.select(
        *slices, "position", "pct", "peptide",
        F.substring(F.col("peptide"), F.col("position") - F.col("start") + 1, F.lit(1)).alias("aminoacid"),
    )


def position_extent(predictions: DataFrame, method: str) -> DataFrame:
    """Axis of the heat map: from 1 to the largest end."""
    usable = _chosen(predictions, method).where(F.col("pct").isNotNull())
    return usable.groupBy("seq_no", "peptide_length").agg(
        F.lit(1).alias("first"), F.greatest(F.max("end"), F.lit(1)).alias("last")
    )


def min_percentile_by_peptide(
    predictions: DataFrame, method: str, sequence: int, length: int | None = None, allele: str | None = None
) -> DataFrame:
    """Lowest percentile of each peptide over the alleles, or that of the selected allele.

    A selected allele's peptide that occurs twice keeps the value of its last occurrence.
    """
    part = filter_predictions_slice(predictions, sequence, length, allele)
    rows = _chosen(part, method).where(F.col("pct").isNotNull() & ~F.isnan("pct")).withColumn(
        "peptide", peptide_key(F.col("peptide"))
    ).where("peptide <> ''")
    value = F.min("pct") if allele is None else F.max_by("pct", F.struct("start", "pct"))
    return rows.groupBy("peptide").agg(value.alias("pct"))


def available_lengths(
    predictions: DataFrame, requested: tuple[int, int], sequences: DataFrame | None = None
) -> DataFrame:
    """Per sequence the requested lengths that occur in it; all of them when none at all occurs.

    ``sequences`` adds sequences (``seq_no``) that have no predictions yet.
    """
    low, high = min(requested), max(requested)
    asked = F.sequence(F.lit(low), F.lit(high))
    seen = predictions.select(
        sequence_number(predictions).alias("seq_no"), peptide_length(predictions).alias("length")
    ).distinct()
    # Distinct peptide lengths of one sequence: a short list.
    found = seen.groupBy("seq_no").agg(F.collect_set("length").alias("lengths"))
    if sequences is not None:
        found = sequences.select("seq_no").distinct().join(found, "seq_no", "left")
    offered = F.when(F.size("lengths") > 0, F.array_intersect(asked, "lengths")).otherwise(asked)
    return found.select("seq_no", F.explode(offered).alias("length"))


def label_sequences(predictions: DataFrame, names: DataFrame) -> DataFrame:
    """Attach the FASTA id ``(seq_no, id)`` of each row's sequence, else ``seqN``."""
    numbered = predictions.withColumn("seq_no", sequence_number(predictions, LABEL_SEQUENCE_NAMES))
    labelled = lookup_join(numbered, names.select("seq_no", "id").where("id <> ''"), "seq_no", "left")
    return labelled.withColumn(
        "label", F.coalesce("id", F.concat(F.lit("seq"), F.col("seq_no").cast("string")))
    ).drop("id", "seq_no")


def cleaned_peptides(peptides: DataFrame) -> DataFrame:
    """Upper-case peptides without white space and gaps that hold residues only."""
    bare = F.regexp_replace(F.upper("peptide"), r"[\s-]", "")
    return peptides.withColumn("peptide", bare).where(is_residues_only(F.col("peptide")))
