from __future__ import annotations

from urllib.parse import unquote

from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epitrove.operators import filters as flt, frequencies as frq, values as val
from epitrove.operators.filters import IsolateFilter

COLUMNS = "protein string, genotype string, host string, country string, collection_date string, release_date string, sequence string"


@pytest.fixture(scope="module")
def isolates(spark):
    return spark.createDataFrame([
        ("M1", "H1N1", "Homo sapiens", "A", "2020", "2020-01-01", "MKT"),
        ("M1", "H1N1", "Homo sapiens", "A", "2020-05", "2020-02-01", "MKT"),
        ("M1", "H2N2", " Gallus ", "B", "2020-05-07", "2021-01-01", "MK-"),
        ("M1", "H3N2", None, "C", "", "", "ART"),
        ("M1", "H3N2", "Gallus", None, "unknown", None, "MKTV"),
        ("M1", "H3N2", "Gallus", "A", None, None, None),
        ("M1", "H3N2", "Gallus", "A", None, None, ""),
        ("HA", "H3N2", "Gallus", "A", "2019", "2019", "GG"),
    ], COLUMNS)


def kept(isolates, **wanted):
    return flt.filter_isolates(isolates, IsolateFilter(protein="M1", **wanted)).count()


def test_empty_filters_keep_everything(isolates):
    assert kept(isolates) == 7
    assert kept(isolates, host_categories=("Human", "Non-human")) == 7


def test_host_filters(isolates):
    assert kept(isolates, host_categories=("Human",)) == 2
    assert kept(isolates, host_categories=("Non-human",)) == 4
    assert kept(isolates, hosts=("Gallus",)) == 3
    assert kept(isolates, hosts=("Gallus",), trimmed=True) == 4


def test_date_filters_are_closed_and_drop_rows_without_a_date(isolates):
    assert kept(isolates, collected=("2020-01-01", "2020-05-01")) == 2
    assert kept(isolates, collected=("2020-05-01", None)) == 2
    assert kept(isolates, collected=(None, "2020-01-01")) == 1
    assert kept(isolates, released=("2020-02-01", None)) == 2


def test_filters_reach_the_scan(spark, isolates, tmp_path):
    isolates.write.partitionBy("protein").parquet(str(tmp_path / "t"))
    wanted = IsolateFilter(protein="M1", genotypes=("H1N1",), host_categories=("Human",))
    plan = flt.filter_isolates(spark.read.parquet(str(tmp_path / "t")), wanted).select("sequence")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(protein" in text
    assert "EqualTo(genotype,H1N1)" in text and "EqualTo(host,Homo sapiens)" in text
    assert "country" not in text


def by_hand(sequences):
    counts, singles = Counter(), Counter()
    for sequence in sequences:
        counts.update(enumerate(sequence, 1))
    for sequence in set(sequences):
        singles.update(enumerate(sequence, 1))
    return {key: (counts[key], singles[key]) for key in counts}


def test_position_frequencies(isolates):
    live = frq.position_frequencies(flt.filter_isolates(isolates, IsolateFilter(protein="M1"))).collect()
    expected = by_hand(["MKT", "MKT", "MK-", "ART", "MKTV", ""])
    assert {(r["position"], r["aminoacid"]): (r["frequency_all"], r["frequency_unique"]) for r in live} == expected
    for position in {r["position"] for r in live}:
        part = [r for r in live if r["position"] == position]
        assert sum(r["value"] for r in part) == pytest.approx(1)
        assert sum(r["value_unique"] for r in part) == pytest.approx(1)
        assert all(r["frequency_unique"] <= r["frequency_all"] for r in part)


def test_a_hot_sequence_is_reduced_before_it_is_taken_apart(spark):
    hot = spark.range(30000).select(F.lit("MKTAYI").alias("sequence")).unionByName(
        spark.range(50).select(F.concat(F.lit("MK"), F.col("id").cast("string")).alias("sequence")))
    live = {(r["position"], r["aminoacid"]): r for r in frq.position_frequencies(hot).collect()}
    assert live[1, "M"]["frequency_all"] == 30050 and live[1, "M"]["frequency_unique"] == 51
    assert live[3, "T"]["frequency_all"] == 30000 and live[3, "T"]["frequency_unique"] == 1


def test_fast_path_is_taken_only_without_other_filters(isolates, spark, tmp_path):
    path = str(tmp_path / "stored")
    frq.build_position_table(isolates, path)
    stored = spark.read.parquet(path)
    fast = frq.position_frequencies_fast(isolates, stored, IsolateFilter(protein="M1"))
    live = frq.position_frequencies(flt.filter_isolates(isolates, IsolateFilter(protein="M1")))
    assert rows(fast) == rows(live.select(fast.columns))
    assert fast.inputFiles() and all(f"{path}/" in unquote(f) for f in fast.inputFiles())
    filtered = frq.position_frequencies_fast(isolates, stored, IsolateFilter(protein="M1", countries=("A",)))
    assert not any(f"{path}/" in unquote(f) for f in filtered.inputFiles())
    assert filtered.where("position = 1").first()["total_all"] == 2


def frequencies(spark, *cells):
    return spark.createDataFrame(list(cells), "position int, aminoacid string, value double")


def test_ties_of_the_consensus_go_to_the_smaller_letter(spark):
    table = frequencies(spark, (1, "T", 0.5), (1, "A", 0.5), (2, "C", 1.0))
    assert rows(frq.consensus(table)) == [(1, "A"), (2, "C")]
    assert rows(frq.residue_ranking(table)) == [(1, "A", 0.5, 1), (1, "T", 0.5, 2), (2, "C", 1.0, 1)]


def test_all_residues_at_the_maximum_leave_the_stack(spark):
    table = frequencies(spark, (1, "A", 0.4), (1, "C", 0.4), (1, "D", 0.15), (1, "E", 0.05), (2, "A", 1.0))
    stack = rows(frq.diversity_stack(table))
    assert [(p, a) for p, a, _, _ in stack] == [(1, "D"), (1, "E")]
    assert [y for _, _, *pair in stack for y in pair] == pytest.approx([0, 0.15, 0.15, 0.2])


def test_profile_fills_holes_and_keeps_the_last_row(spark):
    stored = spark.createDataFrame([("M1", 1, "A", 0.4, 1), ("M1", 1, "A", 0.1, 2), ("M1", 3, "C", 1.0, 3)],
                                   "protein string, position int, aminoacid string, value double, line int")
    profile = frq.load_profile(stored, ["line"]).orderBy("position").collect()
    assert [(r["position"], r["shares"]) for r in profile] == [(1, {"A": 0.1}), (2, {}), (3, {"C": 1.0})]


def test_facets_are_capped_and_the_missing_level_drops_out(isolates):
    every = flt.filter_isolates(isolates, IsolateFilter(protein="M1"))
    weighted = frq.distinct_sequences(flt.select_facet(every, "country"), ["facet"])
    assert rows(frq.top_facets(weighted, most=2)) == [("A", 3), ("B", 1)]
    assert {r["facet"] for r in frq.facet_conservation(every, "country").collect()} == {"A", "B", "C"}
    top = frq.facet_conservation(every, "country", unique=True, most=1).orderBy("position").collect()
    assert [(r["aminoacid"], r["frequency"], r["value_unique"], r["value"]) for r in top] == [
        ("M", 1, 1.0, None), ("K", 1, 1.0, None), ("T", 1, 1.0, None)]


def test_facets_are_offered_for_set_filters_only():
    assert flt.facet_choices(IsolateFilter(protein="M1", countries=("A",), genotypes=("x",))) == ["genotype", "country"]
    assert flt.facet_choices(IsolateFilter(host_categories=("Human",))) == []


def test_metric_delta(isolates):
    delta = frq.metric_delta(isolates, IsolateFilter(protein="M1"), IsolateFilter(protein="M1", countries=("A",))).first()
    assert delta.asDict() == {
        "total_all_previous": 5, "total_all_current": 2, "total_unique_previous": 4, "total_unique_current": 1,
        "total_all_delta": -3, "total_unique_delta": -3}


def test_reference_against_consensus(spark):
    reference = spark.createDataFrame([("MK-A",)], "aligned_sequence string")
    agreed = spark.createDataFrame([(1, "M"), (2, "R"), (3, "-"), (5, "T")], "position int, aminoacid string")
    assert rows(frq.compare_reference_consensus(reference, agreed)) == [
        (1, "M", "M", True, False), (2, "K", "R", False, False), (3, "-", "-", True, True),
        (4, "A", None, False, False), (5, None, "T", False, False)]


def test_value_pages(isolates):
    assert [r[0] for r in val.page_values(isolates, "host").collect()] == ["Gallus", "Homo sapiens"]
    assert [r[0] for r in val.page_values(isolates, "host", "h").collect()] == ["Gallus", "Homo sapiens"]
    assert [r[0] for r in val.page_values(isolates, "host", "o_x").collect()] == []
    assert [r[0] for r in val.page_values(isolates, "host", "O%AP").collect()] == ["Homo sapiens"]
    assert flt.search_values(isolates, "host", "O%AP", literal=True).count() == 0
    assert flt.search_values(isolates, "host", "o SAP", literal=True).count() == 2
    assert [r[0] for r in val.page_values(isolates, "host", offset=1).collect()] == ["Homo sapiens"]


def test_attribute_categories_flag_blanks(spark):
    table = spark.createDataFrame([("b",), ("a",), (" ",), (None,), ("a",)], "kind string")
    assert rows(flt.attribute_categories(table, "kind")) == [(None, True), ("a", False), ("b", False)]


def test_class_lengths(spark):
    table = spark.createDataFrame([("ACDEFG--",), ("ACDEFGHI--",), ("ACDEFGHIK--",), ("A" * 31,)], "peptide string")
    kept, excluded = flt.filter_peptide_length(table, "I")
    assert rows(kept) == [("ACDEFGHI",), ("ACDEFGHIK",)] and excluded.count() == 2
    kept, excluded = flt.filter_peptide_length(table, "II")
    assert rows(kept) == [("ACDEFGHIK--",)] and excluded.count() == 3


def test_what_counts_as_aligned(spark):
    table = spark.createDataFrame([
        (1, "MisAligned", "AC"), (2, "aligned", None), (3, "x", "AC"), (4, None, "AC"), (5, None, ""), (6, "x", None)],
        "n int, status string, peptide_aligned string")
    assert {r["n"] for r in flt.classify_aligned(table).where("is_aligned").collect()} == {2, 3, 4}
    placed = spark.createDataFrame([(1, None), (2, 4)], "n int, aln_end int")
    assert {r["n"] for r in flt.classify_aligned(placed).where("is_aligned").collect()} == {2}
