"""Parquet and delimited sources: isolates, stored frequencies, alleles, peptides, predictions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epitrove.functions.schema import allele_column, quoted, require_columns
from epitrove.functions.text import strip
from epitrove.plans.joins import inline_rows

# Protein lists of the two isolate collections.
COLLECTION_PROTEINS = {
    "A": ("M1", "M2", "HA", "PAX", "NA", "PB1F2", "NP", "NS1", "NS2", "PA", "PB1", "PB2"),
    "B": ("BM2", "HA", "M1", "NA", "NB", "NEP", "NP", "NS1", "PA", "PB1", "PB2"),
}
COLLECTION_PREFIX = {"A": "", "B": "IBV_"}

FREQUENCY_COLUMNS = (
    "position", "aminoacid", "frequency_all", "total_all", "value",
    "frequency_unique", "total_unique", "value_unique",
)
PREDICTION_SCHEMA = (
    "allele string, peptide string, netmhcpan_el_percentile float, netmhcpan_ba_percentile float"
)
ANNOTATED_NUMBERS = (
    "netmhcpan_el_percentile", "netmhcpan_ba_percentile", "frequency_all", "total_all",
    "proportion_all", "frequency_unique", "total_unique", "proportion_unique",
)


def collection_protein(collection: str, protein: str) -> str:
    """Protein id without the collection's prefix; ids outside the collection are refused."""
    name = protein.removeprefix(COLLECTION_PREFIX[collection])
    if name not in COLLECTION_PROTEINS[collection]:
        raise ValueError(f"not a protein of collection {collection}: {protein}")
    return name


def scan_sequences(spark: SparkSession, root: str, protein: str, collection: str | None = None) -> DataFrame:
    """Isolates of one protein from a table stored by protein; only that partition is read.

    With a ``collection`` the id is checked against its list and a prefix in front of it is ignored.
    """
    name = protein if collection is None else collection_protein(collection, protein)
    return spark.read.parquet(root).where(F.col("protein") == name)


def scan_position_frequencies(spark: SparkSession, root: str, protein: str) -> DataFrame:
    """Stored position frequencies of one protein."""
    return spark.read.parquet(root).where(F.col("protein") == protein).select(*FREQUENCY_COLUMNS)


def read_allele_list(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sorted distinct alleles of the column found under one of ``names``; empty when there is none."""
    found = allele_column(table.columns, names)
    if found is None:
        return table.sparkSession.createDataFrame([], "allele string")
    allele = strip(quoted(found).cast("string")).alias("allele")
    return table.select(allele).where(F.col("allele") != "").distinct().orderBy("allele")


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """All columns as text. A file whose header differs from the first one's is an error, not a mix-up."""
    return spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, **options)


def _header_key(header: str) -> str:
    return re.sub(r"\s+", "_", header.lower())


def _attribute_source(headers: dict[str, str], number: int) -> str | None:
    for key, column in headers.items():
        digits = re.search(r"\d+", key)
        if key.startswith("attribute") and digits and int(digits.group()) == number:
            return column
    return None


def read_peptides_csv(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded peptides from quoted CSV files: peptide, protein and up to three attributes."""
    table = _csv(spark, path, quote='"', escape='"')
    headers = {_header_key(column): column for column in table.columns}

    def cell(column: str | None) -> Column:
        if column is None:
            return F.lit(None).cast("string")
        return F.coalesce(strip(quoted(column)), F.lit(""))

    def required(key: str) -> Column:
        return F.coalesce(cell(headers.get(key)), F.lit(""))

    return table.select(
        F.upper(required("peptide")).alias("peptide"),
        required("protein").alias("protein"),
        *[cell(_attribute_source(headers, i)).alias(f"attribute_{i}") for i in (1, 2, 3)],
    )


def read_peptides_csv_simple(spark: SparkSession, path: str) -> DataFrame:
    """Peptide and protein columns of unquoted CSV files; no ``peptide`` header, no rows."""
    table = _csv(spark, path, quote="")
    headers = {column.strip().lower(): column for column in reversed(table.columns)}
    if "peptide" not in headers:
        return spark.createDataFrame([], "peptide string, protein string")
    protein = strip(quoted(headers["protein"])) if "protein" in headers else F.lit(None).cast("string")
    return table.select(
        F.upper(strip(quoted(headers["peptide"]))).alias("peptide"), protein.alias("protein")
    ).where(F.length("peptide") > 0)


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Annotated predictions: trimmed names, upper-case peptide and roots, numeric measures."""
    table = _csv(spark, path, quote='"', escape='"')
    require_columns(table, ["protein", "allele", "peptide", "root", "proportion_all", "netmhcpan_el_percentile"])
    text = {
        "protein": strip(F.coalesce("protein", F.lit(""))),
        "allele": strip(F.coalesce("allele", F.lit(""))),
        "peptide": F.upper(F.coalesce("peptide", F.lit(""))),
        "root": F.upper(F.coalesce("root", F.lit(""))),
    }
    numbers = {c: quoted(c).try_cast("double") for c in ANNOTATED_NUMBERS if c in table.columns}
    return table.select(*[value.alias(name) for name, value in {**text, **numbers}.items()])


def read_predictions_csv_wide(spark: SparkSession, path: str) -> DataFrame:
    """Allele, peptide and both percentiles of wide CSV files; the other columns are not parsed."""
    header = _csv(spark, path)
    names = [field.split(" ")[0] for field in PREDICTION_SCHEMA.split(", ")]
    require_columns(header, names)
    return header.select(
        "allele", "peptide", *[F.col(name).cast("float").alias(name) for name in names[2:]]
    )


def inline_windows(spark: SparkSession, windows: Iterable[tuple[int, int]]) -> DataFrame:
    """A small ``(start, len)`` relation from Python values; non-positive windows are dropped."""
    return inline_rows(spark, valid_windows(windows), "start int, len int")


def valid_windows(windows: Iterable[tuple[float, float]]) -> list[tuple[int, int]]:
    whole = [(int(start), int(length)) for start, length in windows]
    return list(dict.fromkeys((s, n) for s, n in whole if s > 0 and n > 0))
