from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epitrove.operators import filters as flt, predictions as prd, summaries as smy

PAIR = "allele string, peptide string, netmhcpan_el_percentile double, netmhcpan_ba_percentile double"
SCAN = ("`seq #` int, `peptide length` int, allele string, peptide string, start int, `end` int, "
        "`netmhcpan_el percentile` double")


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([
        ("HLA-A*02:01", "ACD", 1.0, 10.0), ("HLA-A*02:01", "EFG", 3.0, None), ("HLA-B*07:02", "ACD", 60.0, 0.5)], PAIR)


def test_missing_pairs(spark, pairs):
    work = spark.createDataFrame([("acd",), ("EFG",), ("HIK",), ("HIK",)], "peptide string")
    missing = prd.missing_predictions(work, ["hla-a*02:01", "HLA-B*07:02"], pairs)
    assert rows(missing) == [("HLA-B*07:02", "EFG"), ("HLA-B*07:02", "HIK"), ("hla-a*02:01", "HIK")]
    alleles, peptides = prd.request_of_missing(missing)
    assert rows(alleles) == [("HLA-B*07:02",), ("hla-a*02:01",)] and rows(peptides) == [("EFG",), ("HIK",)]
    assert prd.missing_predictions(work, [], pairs).count() == 0


def test_fresh_rows_replace_cached_ones(spark, pairs):
    fresh = spark.createDataFrame([("HLA-A*02:01", "ACD", None, 9.0, 1), ("HLA-A*02:01", "ACD", 2.0, 8.0, 2),
                                   ("HLA-C*01:02", "ACD", 5.0, 5.0, 1)], PAIR + ", line int")
    merged = prd.merge_predictions(pairs.withColumn("line", F.lit(99)), fresh, ["line"]).drop("line")
    assert rows(merged) == [("HLA-A*02:01", "ACD", 2.0, 8.0), ("HLA-A*02:01", "EFG", 3.0, None),
                            ("HLA-B*07:02", "ACD", 60.0, 0.5), ("HLA-C*01:02", "ACD", 5.0, 5.0)]


def test_restriction_and_lookup(spark, pairs):
    work = spark.createDataFrame([("acd",), ("zzz",)], "peptide string")
    assert rows(prd.restrict_predictions(pairs, work, ["hla-a*02:01"]).select("allele", "peptide")) == [("HLA-A*02:01", "ACD")]
    listed = spark.createDataFrame([(" a-c d\n",), ("",)], "peptide string")
    assert prd.predictions_for_peptides(pairs, listed).count() == 2
    assert rows(prd.cleaned_peptides(listed.unionAll(work))) == [("ACD",), ("ACD",)]


def test_overlay_keeps_every_row_and_allele(spark, pairs):
    shown = spark.createDataFrame([(1, "A-CD"), (2, "efg"), (3, "QQ")], "rank int, peptide string")
    grid = prd.overlay_percentiles(shown, ["HLA-A*02:01", "hla-b*07:02"], pairs)
    assert rows(grid.select("rank", "allele", "netmhcpan_el_percentile", "netmhcpan_ba_percentile")) == [
        (1, "HLA-A*02:01", 1.0, 10.0), (1, "hla-b*07:02", 60.0, 0.5), (2, "HLA-A*02:01", 3.0, None),
        (2, "hla-b*07:02", None, None), (3, "HLA-A*02:01", None, None), (3, "hla-b*07:02", None, None)]


def test_overlay_of_both_classes(spark):
    """Each row has the percentiles of its class; class I comes first, and pairs keep their last finite value."""
    table = spark.createDataFrame([
        ("A", "ACD", 1, 1, 5.0, None, 7.0), ("A", "ACD", 2, 1, None, 6.0, None), ("B", "ACD", 1, 2, None, None, 8.0), ("B", "ACD", 1, 1, 1.0, 2.0, 3.0),
        ("B", "ACD", None, 9, 4.0, None, None)],
        "allele string, peptide string, seq_no int, start int, `netmhcpan_el percentile` double, netmhciipan_ba_percentile float, `netmhciipan_el percentile` double")
    grid = prd.overlay_percentiles(spark.createDataFrame([("ACD",)], "peptide string"), ["A", "B"], table, ["seq_no", "start"])
    assert rows(grid) == [("ACD", "A", 5.0, 6.0), ("ACD", "B", 8.0, 2.0)]
    assert "SortAggregate" not in grid._jdf.queryExecution().executedPlan().toString()


def test_percentile_by_spelling_of_the_allele(spark, pairs):
    bars = spark.createDataFrame([(1, "ACD", None), (2, "QQ", "A-CD"), (3, "EFG", "EFG"), (4, None, None)],
                                 "n int, peptide string, peptide_aligned string")
    for spelling in ("a0201", "HLA-A*02:01"):
        found = prd.percentile_by_allele_key(bars, spelling, pairs)
        assert rows(found.select("n", "percentile")) == [(1, 1.0), (2, 1.0), (3, 3.0), (4, None)]
    assert rows(prd.percentile_by_allele_key(bars, "A0201", pairs, "BA").select("n", "percentile"))[2] == (3, None)


def test_matrix_has_a_column_per_allele(pairs):
    matrix = prd.allele_matrix(pairs, ["HLA-B*07:02", "HLA-A*02:01", "HLA-X"])
    assert matrix.columns == ["peptide", "HLA-B*07:02", "HLA-A*02:01", "HLA-X"]
    assert rows(matrix) == [("ACD", 60.0, 1.0, None), ("EFG", None, 3.0, None)]


def test_heat_map_against_brute_force(spark):
    dice = random.Random(4)
    scan = []
    for sequence, allele, start in {(dice.randint(1, 2), dice.choice("AB"), dice.randint(1, 30)) for _ in range(80)}:
        scan.append((None if sequence == 1 else 2, 4, allele, "".join(dice.choices("ACDE", k=4)), start, start + 3,
                     float(dice.randint(1, 6))))
    scan += [(1, 4, "A", "ACDE", 5, 8, None), (1, 4, "A", "ACDE", 5, 8, float("nan")), (1, 4, "A", None, 5, 8, 0.0)]
    best = {}
    for sequence, length, allele, peptide, start, end, pct in scan:
        if pct is None or pct != pct or not peptide:
            continue
        for position in range(start, end + 1):
            key = (sequence or 1, length, allele, position)
            best[key] = min(best.get(key, (1e9,)), (pct, start, peptide))
    expected = {k: (pct, peptide, peptide[k[3] - start]) for k, (pct, start, peptide) in best.items()}
    table = spark.createDataFrame(scan, SCAN)
    cells = prd.min_percentile_by_position(table, "netmhcpan_el").collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in cells} == expected
    assert rows(prd.position_extent(table, "netmhcpan_el"))[0][:3] == (1, 4, 1)


@pytest.fixture(scope="module")
def scan(spark):
    return spark.createDataFrame([
        (None, 3, "A", "ACD", 1, 3, 5.0), (None, 3, "B", "acd", 1, 3, 2.0), (None, 3, "A", "ACD", 7, 9, 4.0),
        (None, 4, "A", "ACDE", 1, 4, 1.0), (2, 4, "A", "GGGG", 1, 4, None), (2, 5, "A", "GGGGG", 1, 5, 9.0)], SCAN)


def test_peptide_minima(scan):
    assert rows(prd.min_percentile_by_peptide(scan, "netmhcpan_el", 1, 3)) == [("ACD", 2.0)]
    assert rows(prd.min_percentile_by_peptide(scan, "netmhcpan_el", 1, 3, "A")) == [("ACD", 4.0)]
    assert rows(prd.min_percentile_by_peptide(scan, "netmhcpan_el", 1)) == [("ACD", 2.0), ("ACDE", 1.0)]


def test_lengths_and_labels(spark, scan):
    assert rows(prd.available_lengths(scan, (5, 4))) == [(1, 4), (2, 4), (2, 5)]
    more = spark.createDataFrame([(2,), (3,)], "seq_no int")
    assert rows(prd.available_lengths(scan, (4, 5), more)) == [(2, 4), (2, 5), (3, 4), (3, 5)]
    names = spark.createDataFrame([(2, "two"), (3, "three")], "seq_no int, id string")
    assert {r["label"] for r in prd.label_sequences(scan, names).collect()} == {"seq1", "two"}


def test_slices(scan):
    assert flt.filter_predictions_slice(scan, 1, 3, "A").count() == 2
    assert flt.filter_predictions_slice(scan, 2).count() == 2


def test_normal_form(spark):
    raw = spark.createDataFrame([("hla-a*02:01", "acd", "1.5", "x")],
                                "allele string, peptide string, `netmhcpan_el percentile` string, `netmhcpan_ba percentile` string")
    assert rows(flt.normalize_predictions(raw)) == [("HLA-A*02:01", "ACD", 1.5, None)]


@pytest.fixture(scope="module")
def annotated(spark):
    return spark.createDataFrame([
        ("M1", "A", "P", 2.0, 0.5, "P"), ("M1", "B", "P", 2.1, 0.5, "P"), ("M1", "C", "P", None, 0.5, "P"),
        ("M1", "A", "Q", 1.0, 0.25, "P;R"), ("M1", "B", "Q", 1.0, 0.25, "P"), ("M1", "A", "R", 1.0, None, "R"),
        ("M1", "A", "S", 1.0, 0.1, ""), ("HA", "A", "P", 9.0, 0.9, "P")],
        "protein string, allele string, peptide string, netmhcpan_el_percentile double, proportion_all double, root string")


def test_binders(annotated):
    assert rows(smy.binders_per_peptide(annotated)) == [("HA", "P", 0.9, 0, 1), ("M1", "P", 0.5, 1, 3), ("M1", "R", None, 1, 1)]
    assert flt.filter_root_rows(annotated, "A").count() == 3


def test_windows_score_counts_rows_whose_root_binds(annotated):
    assert rows(smy.windows_score(annotated)) == [("M1", "P", 0.75, 2, 1), ("M1", "R", 0.25, 2, 1)]


def test_histogram_edges(spark):
    values = [0.0, 0.05, 0.049, 0.85, 0.95, 1.0, 1.01, -0.1, None, 0.15]
    table = spark.createDataFrame([(v, "M1") for v in values] + [(0.5, None)], "proportion_all double, protein string")
    # The lower edges of bins 3, 17 and 19 are products a little above 0.15, 0.85 and 0.95.
    assert rows(smy.proportion_histogram(table)) == rows(spark.createDataFrame(
        [(0, "M1", 2), (1, "M1", 1), (2, "M1", 1), (16, "M1", 1), (18, "M1", 1), (19, "M1", 1), (10, "Unknown", 1)], "b int, p string, n int"))


def test_protein_report(spark):
    table = spark.createDataFrame([("M1",), ("M1",), ("HA",), (None,), ("NP",)], "protein string")
    assert [tuple(r) for r in smy.protein_row_counts(table, 2).collect()] == [("M1", 2, 3), ("HA", 1, 3)]
