from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from epitrove.functions import schema
from epitrove.functions.text import (
    allele_key, partial_date, peptide_key, percentile_band, protein_key, residue_group,
)


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("2020", datetime.date(2020, 1, 1)), ("2020-05", datetime.date(2020, 5, 1)),
    ("2020-05-07", datetime.date(2020, 5, 7)), ("2020/05/07", datetime.date(2020, 5, 7)),
    ("", None), (None, None), ("unknown", None), ("2020-5", None), ("2020-13-01", None), ("20ab", None),
])
def test_partial_dates_are_padded_and_others_dropped(spark, text, expected):
    assert one(spark, text, partial_date) == expected


@pytest.mark.parametrize("percentile, band", [
    (0.0, "strong"), (2.0, "strong"), (2.1, "medium"), (50.0, "medium"), (50.1, "weak"), (None, "no data"),
    (float("nan"), "no data"),
])
def test_percentile_bands(spark, percentile, band):
    assert one(spark, percentile, percentile_band, "double") == band


def test_residue_groups_cover_the_alphabet(spark):
    groups = {r: one(spark, r, residue_group) for r in "ACDEFGHIKLMNPQRSTVWY"}
    assert None not in groups.values() and len(set(groups.values())) == 7
    assert one(spark, "-", residue_group) is None and one(spark, "X", residue_group) is None


def test_keys_ignore_spelling(spark):
    assert one(spark, "hla-a*02:01", allele_key) == one(spark, "A0201", allele_key) == "A0201"
    assert one(spark, " p b1\t", protein_key) == "PB1"
    assert one(spark, " ac-d\n", peptide_key) == "ACD"


def test_percentile_column_falls_back_step_by_step():
    exact = ["allele", "netmhcpan_ba percentile", "netmhcpan_el percentile"]
    assert schema.percentile_column(exact, "netmhcpan_el") == "netmhcpan_el percentile"
    assert schema.percentile_column(["Percentile netmhcpan_EL"], "netmhcpan_el") == "Percentile netmhcpan_EL"
    assert schema.percentile_column(["allele", "any Percentile"], "netmhcpan_el") == "any Percentile"
    assert schema.percentile_column(["allele"], "netmhcpan_el") == "netmhcpan_el percentile"
    assert schema.percentile_column(["allele"], "other") is None


def test_class_percentile_column_ignores_separators():
    assert schema.class_percentile_column(["NetMHCpan-EL Percentile"], "I", "EL") == "NetMHCpan-EL Percentile"
    assert schema.class_percentile_column(["netmhciipan_ba_percentile"], "II", "ba") == "netmhciipan_ba_percentile"
    assert schema.class_percentile_column(["el_percentile"], "II", "EL") == "el_percentile"
    assert schema.class_percentile_column(["my el percent"], "I", "EL") == "my el percent"
    assert schema.class_percentile_column(["allele"], "I", "EL") is None


def test_allele_column_prefers_an_equal_name():
    assert schema.allele_column(["my class i", "CLASS I"], ["Class I"]) == "CLASS I"
    assert schema.allele_column(["my class i"], ["Class I"]) == "my class i"
    assert schema.allele_column(["x"], ["Class I"]) is None


def test_sequence_number_and_length_defaults(spark):
    rows = spark.createDataFrame([(None, 9), (4, 8)], "`seq #` int, length int")
    picked = rows.select(schema.sequence_number(rows).alias("s"), schema.peptide_length(rows).alias("n"))
    assert {tuple(r) for r in picked.collect()} == {(1, 9), (4, 8)}
    assert rows.drop("seq #").select(schema.sequence_number(rows.drop("seq #"))).distinct().first()[0] == 1
