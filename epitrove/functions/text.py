"""String expressions shared by the operators. All of them are JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The residue alphabet.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Residue property groups.
RESIDUE_GROUPS = {
    "aliphatic": "PGALVI",
    "aromatic": "YWF",
    "sulfur-containing": "MC",
    "hydroxylic": "ST",
    "basic": "HKR",
    "acidic": "DE",
    "amidic": "NQ",
}


def strip(text: Column) -> Column:
    """Remove all white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ungapped(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def peptide_key(text: Column) -> Column:
    """Upper case, no gaps, no outer white space: the form peptides are compared in."""
    return strip(F.upper(ungapped(text)))


def protein_key(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def allele_key(text: Column) -> Column:
    """``HLA-A*02:01`` and ``a0201`` share the key ``A0201``."""
    return F.regexp_replace(F.regexp_replace(F.upper(text), "^HLA-", ""), "[^A-Z0-9]", "")


def is_nonblank(text: Column) -> Column:
    return text.isNotNull() & (F.length(F.trim(text)) > 0)


def is_residues_only(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^[{RESIDUES}]+$"), F.lit(False))


def letters(text: Column) -> Column:
    """One array element per character; callers drop empty strings first."""
    return F.split(text, "")


def residue_group(residue: Column) -> Column:
    """Property group of a residue; NULL for gaps and unknown letters."""
    chain = None
    for group, members in RESIDUE_GROUPS.items():
        hit = residue.isin(list(members))
        chain = F.when(hit, group) if chain is None else chain.when(hit, group)
    return chain


def percentile_band(percentile: Column) -> Column:
    """Up to 2 is strong, up to 50 medium, above weak; missing values have no data."""
    return (
        F.when(percentile.isNull() | F.isnan(percentile), "no data")
        .when(percentile <= 2, "strong")
        .when(percentile <= 50, "medium")
        .otherwise("weak")
    )


def partial_date(text: Column) -> Column:
    """DATE from ``YYYY``, ``YYYY-MM`` or a full date; anything else is NULL.

    The shape test keeps out short forms (``2020-5``) and text after the date that Spark alone
    would accept.
    """
    padded = (
        F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01")))
        .when(F.length(text) == 7, F.concat(text, F.lit("-01")))
        .otherwise(text)
    )
    dashed = F.regexp_replace(padded, r"^(\s*\d{4})/(\d{1,2})/", "$1-$2-")
    return F.when(dashed.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"), dashed).try_cast("date")
