"""Row predicates and small projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from epitrove.functions.schema import peptide_length, quoted, sequence_number
from epitrove.functions.text import is_nonblank, is_residues_only, partial_date, strip, ungapped

# The host name of the human category and the length ranges of the two classes.
HUMAN = "Homo sapiens"
CLASS_ONE_LENGTHS = (8, 14)
CLASS_TWO_LENGTHS = (11, 30)
FACETS = ("genotype", "host", "country")

DateRange = tuple[str | None, str | None]


@dataclass(frozen=True)
class IsolateFilter:
    """What the filter panel holds. Empty parts let every row pass.

    Values are compared as stored; ``trimmed`` compares them without outer spaces, which costs
    the push-down of these predicates into the Parquet scan.
    """

    protein: str | None = None
    genotypes: Sequence[str] = ()
    hosts: Sequence[str] = ()
    host_categories: Sequence[str] = ()
    countries: Sequence[str] = ()
    collected: DateRange = (None, None)
    released: DateRange = (None, None)
    trimmed: bool = field(default=False)

    def has_only_protein(self) -> bool:
        """Whether the stored frequencies answer the query."""
        return not (
            self.genotypes or self.hosts or self.host_categories or self.countries
            or any(self.collected) or any(self.released)
        )


def one_of(name: str, values: Sequence[str], trimmed: bool = False) -> Column:
    """``IN`` list; an empty list lets every row pass."""
    if not values:
        return F.lit(True)
    column = F.trim(quoted(name)) if trimmed else quoted(name)
    return column.isin([v.strip() if trimmed else v for v in values])


def host_category(categories: Sequence[str], name: str = "host", trimmed: bool = False) -> Column:
    """Human, non-human (hosts that are not known drop out), or everything."""
    column = F.trim(quoted(name)) if trimmed else quoted(name)
    human, other = "Human" in categories, "Non-human" in categories
    if human == other:
        return F.lit(True)
    return column == HUMAN if human else column != HUMAN


def date_between(name: str, limits: DateRange) -> Column:
    """Closed range over partial dates; an open end is None, and rows without a date fail."""
    start, end = limits
    date = partial_date(quoted(name))
    condition = F.lit(True)
    if start:
        condition = condition & (date >= F.lit(start).cast("date"))
    if end:
        condition = condition & (date <= F.lit(end).cast("date"))
    return condition


def isolate_predicate(wanted: IsolateFilter) -> Column:
    parts = [
        one_of("genotype", wanted.genotypes, wanted.trimmed),
        one_of("host", wanted.hosts, wanted.trimmed),
        host_category(wanted.host_categories, trimmed=wanted.trimmed),
        one_of("country", wanted.countries, wanted.trimmed),
        date_between("collection_date", wanted.collected),
        date_between("release_date", wanted.released),
    ]
    condition = F.lit(True) if wanted.protein is None else F.col("protein") == wanted.protein
    for part in parts:
        condition = condition & part
    return condition


def filter_isolates(isolates: DataFrame, wanted: IsolateFilter) -> DataFrame:
    return isolates.where(isolate_predicate(wanted))


def filter_nonblank(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(is_nonblank(quoted(name)))


def search_values(rows: DataFrame, name: str, text: str, literal: bool = False) -> DataFrame:
    """Rows whose value contains ``text`` in any case; ``%`` and ``_`` are wildcards unless ``literal``."""
    if literal:
        return rows.where(F.contains(F.lower(quoted(name)), F.lit(text.lower())))
    # A backslash stands for itself.
    pattern = text.replace("\\", "\\\\")
    return rows.where(quoted(name).ilike(f"%{pattern}%"))


def within_class(peptide: Column, mhc_class: str) -> Column:
    """Class I counts letters without gaps, class II counts every character."""
    if mhc_class == "II":
        return F.length(peptide).between(*CLASS_TWO_LENGTHS)
    return F.length(ungapped(peptide)).between(*CLASS_ONE_LENGTHS)


def filter_peptide_length(peptides: DataFrame, mhc_class: str = "I", name: str = "peptide") -> tuple[DataFrame, DataFrame]:
    """Peptides a class accepts (class I without their gaps) and the excluded ones."""
    fits = F.coalesce(within_class(quoted(name), mhc_class), F.lit(False))
    kept = peptides.where(fits)
    if mhc_class != "II":
        kept = kept.withColumn(name, ungapped(quoted(name)))
    return kept, peptides.where(~fits)


def filter_alphabet(peptides: DataFrame, name: str = "peptide") -> DataFrame:
    return peptides.where(is_residues_only(quoted(name)))


def filter_root_rows(annotated: DataFrame, allele: str | None = None) -> DataFrame:
    """Rows of uploaded peptides themselves, optionally of one allele."""
    kept = annotated.where((F.col("peptide") != "") & (F.col("peptide") == F.col("root")))
    return kept if allele in (None, "All") else kept.where(F.col("allele") == allele)


def filter_frequency(frequencies: DataFrame, at_least: int | Column, without: Iterable[str] = ()) -> DataFrame:
    """Residues (not gaps) seen often enough, outside the excluded proteins."""
    excluded = list(without)
    kept = frequencies.where((F.col("frequency_all") >= at_least) & (F.col("aminoacid") != "-"))
    return kept.where(~F.col("protein").isin(excluded)) if excluded else kept


METRIC_COLUMNS = {
    "value": ("value", "value_unique"),
    "proportion": ("proportion_all", "proportion_unique"),
    "frequency": ("frequency_all", "frequency_unique"),
    "total": ("total_all", "total_unique"),
}


def select_metric(rows: DataFrame, unique: bool, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The keys and the chosen measures, read from the all or from the unique columns."""
    return rows.select(*keys, *[F.col(METRIC_COLUMNS[m][int(unique)]).alias(m) for m in measures])


def facet_choices(wanted: IsolateFilter) -> list[str]:
    """Facets on offer: the columns a filter is set for."""
    offered = {"genotype": wanted.genotypes, "host": wanted.hosts, "country": wanted.countries}
    return [facet for facet in FACETS if offered[facet]]


def select_facet(isolates: DataFrame, facet: str) -> DataFrame:
    if facet not in FACETS:
        raise ValueError(f"unknown facet: {facet}")
    return isolates.select(F.col(facet).alias("facet"), "sequence")


def normalize_predictions(predictions: DataFrame) -> DataFrame:
    """Upper-case allele and peptide and both percentiles as numbers under snake_case names."""
    renamed = {"_".join(c.split()): c for c in predictions.columns}
    return predictions.select(
        F.upper(quoted(renamed["allele"])).alias("allele"),
        F.upper(quoted(renamed["peptide"])).alias("peptide"),
        *[
            quoted(renamed[p]).cast("string").try_cast("double").alias(p)
            for p in ("netmhcpan_el_percentile", "netmhcpan_ba_percentile")
        ],
    )


def filter_predictions_slice(
    predictions: DataFrame, sequence: int, length: int | None = None, allele: str | None = None
) -> DataFrame:
    """Predictions of one sequence, one length and one allele."""
    kept = predictions.where(sequence_number(predictions) == sequence)
    if length is not None:
        kept = kept.where(peptide_length(predictions) == length)
    return kept if allele is None else kept.where(F.col("allele") == allele)


def filter_aligned_for_sequence(occurrences: DataFrame, sequence: int, length: int | None = None) -> DataFrame:
    kept = occurrences.where(F.col("seq_index") == sequence)
    return kept if length is None else kept.where(F.col("length") == length)


def is_aligned(rows: DataFrame) -> Column:
    """A status text decides when it speaks of alignment; else an aligned string or a coordinate does."""
    columns = set(rows.columns)
    evidence = F.lit(False)
    if "peptide_aligned" in columns:
        evidence = evidence | (F.coalesce(F.length("peptide_aligned"), F.lit(0)) > 0)
    for name in ("aligned_start", "aligned_end", "aln_start", "aln_end"):
        if name in columns:
            evidence = evidence | F.col(name).isNotNull()
    if "status" not in columns:
        return evidence
    status = F.lower(F.col("status"))
    return (
        F.when(F.contains(status, F.lit("misalign")), False)
        .when(F.contains(status, F.lit("align")), True)
        .otherwise(evidence)
    )


def classify_aligned(rows: DataFrame, name: str = "is_aligned") -> DataFrame:
    return rows.withColumn(name, is_aligned(rows))


def attribute_categories(rows: DataFrame, attribute: str) -> DataFrame:
    """Distinct filled values, and one row flagged ``missing`` when some value is blank."""
    value = quoted(attribute).cast("string")
    filled = F.coalesce(strip(value) != "", F.lit(False))
    return rows.select(F.when(filled, value).alias("category"), (~filled).alias("missing")).distinct()
