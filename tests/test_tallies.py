from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epitrove.operators import tallies as tly
from epitrove.plans.storage import pin
from epitrove.sources.tables import inline_windows

SEQUENCES = ["MKTAYIAK"] * 5 + ["MKTVYIAK"] * 3 + ["MK-AYIAK", "mktayiak", "MKT", ""]


@pytest.fixture(scope="module")
def isolates(spark):
    return spark.createDataFrame([("M1", s) for s in SEQUENCES] + [("M1", None), ("HA", "GGGG")], "protein string, sequence string")


def m1(isolates):
    return isolates.where("protein = 'M1'")


def test_tallies_count_every_sequence_once_per_window(isolates):
    windows = [(1, 3), (3, 2), (7, 5), (0, 4), (1, 3)]
    tallies = tly.window_tallies(m1(isolates), windows).collect()
    for start, length in {(1, 3), (3, 2), (7, 5)}:
        part = {r["peptide"]: r for r in tallies if (r["start"], r["len"]) == (start, length)}
        every = Counter(s[start - 1:start - 1 + length] for s in SEQUENCES)
        once = Counter(s[start - 1:start - 1 + length] for s in set(SEQUENCES))
        assert {p: r["frequency_all"] for p, r in part.items()} == every
        assert {p: r["frequency_unique"] for p, r in part.items()} == once
        assert {r["total_all"] for r in part.values()} == {len(SEQUENCES)}
        assert sum(r["proportion_unique"] for r in part.values()) == pytest.approx(1)
    assert len({(r["start"], r["len"]) for r in tallies}) == 3


def test_windows_from_a_table_belong_to_their_protein(spark, isolates):
    windows = spark.createDataFrame([("M1", 1, 3), ("HA", 2, 2)], "protein string, start int, len int")
    tallies = tly.window_tallies(isolates, windows, ["protein"])
    assert rows(tallies.where("protein = 'HA'").select("start", "len", "peptide", "total_all")) == [(2, 2, "GG", 1)]
    expected = tly.window_tallies(m1(isolates), [(1, 3)])
    assert rows(tallies.where("protein = 'M1'").drop("protein")) == rows(expected)
    with pytest.raises(ValueError):
        tly.window_tallies(isolates, windows)


def test_listed_windows_leave_the_sequences_where_they_are(spark):
    sequences = spark.range(1 << 24).where("id < 300").select(F.expr("if(id % 3 = 0, 'HA', 'M1')").alias("protein"), F.lit("MKTAYIAK").alias("sequence"))
    windows = inline_windows(spark, [(1, 3), (2, 4), (0, 2)]).select("*", F.explode(F.array(F.lit("M1"), F.lit("NP"))).alias("protein"))
    cut = tly.cross_windows(sequences, windows, ["protein"], ["protein"])
    assert rows(cut.distinct()) == [("M1", 1, 3, "MKT"), ("M1", 2, 4, "KTAY")] and cut.count() == 400
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert inline_windows(spark, []).dtypes == [("start", "int"), ("len", "int")]
    assert inline_windows(spark, []).count() == 0


def test_no_windows_no_tallies(isolates):
    assert tly.window_tallies(isolates, []).count() == 0


def test_an_unseen_selection_gets_a_zero_row(isolates):
    tallies = tly.window_tallies(m1(isolates), [(1, 3)])
    assert tly.window_tallies_selected(tallies, "MKT").count() == tallies.count()
    unseen = tly.window_tallies_selected(tallies, "QQQ").where("peptide = 'QQQ'").first()
    assert (unseen["frequency_all"], unseen["total_all"], unseen["total_unique"], unseen["proportion_all"]) == (0, 12, 6, 0.0)


def ranked_by_hand(part, most):
    by_all = sorted(part, key=lambda r: (-r["proportion_all"], r["peptide"]))
    by_unique = sorted(part, key=lambda r: (-r["proportion_unique"], r["peptide"]))
    ranks = {r["peptide"]: (by_all.index(r) + 1, by_unique.index(r) + 1) for r in part}
    return {p: pair for p, pair in ranks.items() if min(pair) <= most}


def test_candidates_carry_both_exact_ranks(spark):
    dice = random.Random(3)
    sequences = ["".join(dice.choice("ACD") for _ in range(6)) for _ in range(400)] + ["AAAAAA"] * 150
    table = spark.createDataFrame([(s,) for s in sequences], "sequence string")
    tallies = tly.window_tallies(table, [(1, 4), (2, 3), (5, 9)])
    found = tly.top_candidates_by_window(tallies).collect()
    collected = tallies.collect()
    for window in {(1, 4), (2, 3), (5, 9)}:
        part = [r for r in collected if (r["start"], r["len"]) == window]
        ours = {r["peptide"]: (r["r_all"], r["r_u"]) for r in found if (r["start"], r["len"]) == window}
        assert ours == ranked_by_hand(part, 5)


def test_candidates_of_stored_tallies_are_listed_once(spark):
    table = spark.range(3000).select(F.concat(
        F.lit("MK"), *[F.substring(F.md5(F.col("id").cast("string")), i, 1) for i in range(1, 9)]).alias("sequence"))
    tallies = pin(tly.window_tallies(table, [(s, n) for s in range(1, 6) for n in (2, 3, 4)]))
    candidates = tly.top_candidates_by_window(tallies)
    listed = [(r["start"], r["len"], r["peptide"]) for r in candidates.collect()]
    assert len(listed) == len(set(listed)) == candidates.count()


ALIGNED = ("protein string, peptide string, start int, length int, peptide_aligned string")


@pytest.fixture(scope="module")
def uploads(spark):
    return spark.createDataFrame([
        ("M1", "MKTA", 1, 4, "MKTA"), ("M1", "MKA", 1, 4, "MK-A"), ("m1", "AYIA", 4, 4, "AYIA"),
        ("M1", "QQQQ", None, None, None), ("HA", "GG", 1, 2, "GG"), ("M1", "MKTA", 1, 4, "MKTA")], ALIGNED)


def test_windows_of_uploads(uploads):
    assert rows(tly.distinct_windows(uploads, " m1 ")) == [(1, 4), (4, 4)]
    assert rows(tly.distinct_windows(uploads)) == [("HA", 1, 2), ("M1", 1, 4), ("m1", 4, 4)]


def test_upload_tallies_sum_over_windows(isolates, uploads):
    tallies = tly.window_tallies(m1(isolates), [(1, 4), (4, 4)])
    found = {r["peptide"]: r for r in tly.peptide_tallies(uploads, tallies, "M1").collect()}
    assert {p: (r["frequency_all"], r["frequency_unique"], r["total_all"]) for p, r in found.items()} == {
        "MKTA": (5, 1, 12), "mkta": (1, 1, 12), "MK-A": (1, 1, 12), "AYIA": (6, 2, 12), "ayia": (1, 1, 12)}


def test_share_lookup_ignores_gaps_and_defaults_to_zero(isolates, uploads):
    tallies = tly.window_tallies(m1(isolates), [(1, 4), (4, 4)])
    shares = {(r["protein"], r["peptide"]): r["proportion"] for r in tly.peptide_proportion_lookup(uploads, tallies).collect()}
    assert shares == {("M1", "MKTA"): 5 / 12, ("M1", "MKA"): 1 / 12, ("m1", "AYIA"): 6 / 12, ("M1", "QQQQ"): 0, ("HA", "GG"): 0}


def test_summaries_of_uploads(spark, uploads):
    assert rows(tly.aligned_summary(uploads)) == [("HA", 1, 0), ("M1", 4, 1)]
    tallies = spark.createDataFrame([("MKTA", 0.95, 1.0), ("MK-A", 0.96, 0.0), ("MKA", 0.2, 0.0), ("ayia", None, 0.99)],
                                    "peptide string, proportion_all double, proportion_unique double")
    assert rows(tly.conserved_summary(uploads, tallies, " m1")) == [(2, 1)]


def test_roots_and_annotation(spark, isolates, uploads):
    tallies = tly.window_tallies(m1(isolates), [(1, 4), (4, 4)])
    candidates = tly.top_candidates_by_window(tallies)
    roots = tly.window_roots(uploads, candidates, "M1")
    found = {}
    for peptide, root in rows(roots):
        found.setdefault(peptide, set()).add(root)
    assert found["MKTV"] == {"MKTA", "MKA"} and found["VYIA"] == {"AYIA"} and found["QQQQ"] == {"QQQQ"}
    assert found["AYIA"] == {"AYIA"} and "GG" not in found
    predictions = spark.createDataFrame([("a1", "mktv", 1.0, 2.0), ("A1", "QQQQ", 3.0, None), ("A1", "WWWW", None, 1.0)],
                                        "allele string, peptide string, netmhcpan_el_percentile double, netmhcpan_ba_percentile double")
    annotated = {r["peptide"]: r for r in tly.annotate_predictions(predictions, tallies, roots, "M1").collect()}
    assert annotated["MKTV"]["root"] == "MKA;MKTA" and annotated["MKTV"]["frequency_all"] == 3
    assert annotated["QQQQ"]["root"] == "QQQQ" and annotated["QQQQ"]["total_all"] == 0
    assert annotated["WWWW"]["root"] == "" and annotated["WWWW"]["proportion_unique"] == 0.0


def test_frequency_summary_lists_seen_roots_with_alternates(isolates, uploads):
    tallies = tly.window_tallies(m1(isolates), [(1, 4), (4, 4)])
    summary = tly.frequency_summary(uploads, tallies, "M1", most=2)
    assert rows(summary.select("root_peptide", "peptide", "frequency_all", "frequency_unique")) == [
        ("AYIA", "AYIA", 7, 3), ("AYIA", "VYIA", 3, 1),
        ("MKA", "MKA", 1, 1), ("MKA", "MKTA", 6, 2), ("MKA", "MKTV", 3, 1),
        ("MKTA", "MKA", 1, 1), ("MKTA", "MKTA", 6, 2), ("MKTA", "MKTV", 3, 1)]


def test_alternates_in_the_gap_pattern_of_the_selection(isolates):
    tallies = tly.window_tallies(m1(isolates), [(1, 4)])
    alternates = tly.top_alternates(tallies, "MK-TA", most=2)
    assert rows(alternates.select("rank", "peptide", "frequency")) == [(0, "MKTA", 5), (1, "MKTV", 3), (2, "", 1)]
    shown = tly.mismatch_template(alternates, "MK-TA")
    assert rows(shown.select("rank", "display_peptide", "mismatches")) == [
        (0, "MK-TA", "....."), (1, "MK-TV", "....x"), (2, "-", "x")]
    unseen = tly.top_alternates(tallies, "W-W").where("rank = 0").first()
    assert (unseen["peptide"], unseen["frequency"], unseen["proportion"]) == ("WW", 0, 0.0)


def test_all_and_distinct_counts_meet(isolates):
    every = tly.cross_windows(m1(isolates).where("sequence is not null"), [(1, 3)], []).groupBy("start", "len", "peptide").agg(
        F.count("*").alias("frequency_all"))
    once = every.where("peptide <> 'MKT'").withColumnRenamed("frequency_all", "frequency_unique")
    both = tly.full_outer_all_unique(every, once)
    assert rows(both.where("peptide = 'MKT'")) == [(1, 3, "MKT", 9, 0)]


def test_all_proteins_at_once_are_each_protein_alone(spark, isolates, uploads):
    windows = tly.distinct_windows(uploads).withColumn("protein", F.upper("protein")).distinct()
    every = pin(tly.window_tallies(isolates, windows, ["protein"]))
    candidates = tly.top_candidates_by_window(every, by=["protein"])
    predictions = spark.createDataFrame([("a1", "mktv", 1.0, 2.0), ("A1", "GG", 3.0, None)],
                                        "allele string, peptide string, netmhcpan_el_percentile double, netmhcpan_ba_percentile double")
    roots = tly.window_roots(uploads, candidates)
    together = {
        "tallies": tly.peptide_tallies(uploads, every), "summary": tly.frequency_summary(uploads, every),
        "roots": roots.select("protein", "peptide", "root"), "conserved": tly.conserved_summary(uploads, every).select("protein", "conserved", "not_conserved"),
        "annotated": tly.annotate_predictions(predictions, every, roots),
    }
    found = {name: rows(frame) for name, frame in together.items()}
    expected = {name: [] for name in found}
    for protein in ("M1", "HA"):
        own = every.where(F.col("protein") == protein).drop("protein")
        mine = tly.window_roots(uploads, tly.top_candidates_by_window(own), protein)
        parts = {
            "tallies": tly.peptide_tallies(uploads, own, protein), "summary": tly.frequency_summary(uploads, own, protein),
            "roots": mine.select(F.lit(protein), "peptide", "root"),
            "conserved": tly.conserved_summary(uploads, own, protein).select(F.lit(protein), "conserved", "not_conserved"),
            "annotated": tly.annotate_predictions(predictions, own, mine, protein),
        }
        for name, frame in parts.items():
            expected[name] += rows(frame)
    assert {k: sorted(map(str, v)) for k, v in found.items()} == {k: sorted(map(str, v)) for k, v in expected.items()}


def test_nested_windows_equal_each_window_alone(spark):
    """Windows that share a start, some past the end, with hot sequences and groups of different sizes."""
    texts = [("M1", "ACDEFG"), ("M1", "ACDEFG"), ("M1", "ACDQFG"), ("M1", "ACD"), ("M1", ""), ("M1", None), ("NP", "GGGGGGGG"), ("NP", "GGGGGGGG")]
    table = spark.createDataFrame(texts * 3, "protein string, sequence string")
    windows = [(1, 2), (1, 5), (1, 3), (3, 4), (3, 1), (9, 2)]
    by_hand = {}
    for protein, text in texts * 3:
        for start, size in windows if text is not None else []:
            by_hand.setdefault((protein, start, size), []).append((text[start - 1:start - 1 + size], text))
    expected = []
    for (protein, start, size), seen in by_hand.items():
        for peptide in {p for p, _ in seen}:
            among, unique = [p for p, _ in seen].count(peptide), len({t for p, t in seen if p == peptide})
            whole = len({t for _, t in seen})
            expected.append((protein, start, size, peptide, among, len(seen), among / len(seen), unique, whole, unique / whole))
    order = lambda r: tuple((v is not None, str(v)) for v in r)
    listed = spark.createDataFrame([(p, *w) for p in ("M1", "NP") for w in windows], "protein string, start int, len int")
    assert rows(tly.window_tallies(table, windows, ["protein"])) == sorted(expected, key=order)
    assert rows(tly.window_tallies(table, listed, ["protein"])) == sorted(expected, key=order)
    alone = [r[1:] for r in expected if r[0] == "M1"]
    assert rows(tly.window_tallies(table.where("protein = 'M1'"), windows)) == sorted(alone, key=order)


def test_no_join_by_window_and_one_cut_per_start(spark):
    table = spark.createDataFrame([("M1", "ACDEFG")], "protein string, sequence string")
    plan = tly.window_tallies(table, [(1, 2), (1, 5), (1, 3), (3, 4)], ["protein"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("start" not in line and "len#" not in line for line in joins)
    assert plan.count("Generate explode") == 2


@pytest.mark.parametrize("most", [1, 5])
def test_ranks_by_slots_equal_sorting(spark, most):
    dice = random.Random(most)
    tallied = []
    for start in (1, 2, 3):
        for peptide in dice.sample(["".join(p) for p in itertools.product("ACDE", repeat=4)], 60 if start < 3 else 2):
            tallied.append((start, 4, peptide, dice.randint(0, 3), 9, dice.randint(0, 3) / 9, dice.randint(0, 3), 9, dice.randint(0, 3) / 9))
    table = spark.createDataFrame(tallied, "start int, len int, peptide string, frequency_all bigint, total_all bigint, proportion_all double,"
                                           " frequency_unique bigint, total_unique bigint, proportion_unique double")
    expected = []
    for start in (1, 2, 3):
        rows_of = [r for r in tallied if r[0] == start]
        by_all, by_unique = (sorted(rows_of, key=lambda r, m=m: (-r[m], r[2])) for m in (5, 8))
        for row in rows_of:
            ranks = by_all.index(row) + 1, by_unique.index(row) + 1
            if min(ranks) <= most:
                expected.append((start, 4, row[2], *ranks, row[5], row[8], row[3], row[4], row[6], row[7]))
    assert rows(tly.top_candidates_by_window(table, most)) == sorted(expected, key=lambda r: tuple((True, str(v)) for v in r))


def test_summary_reads_windows_from_the_top(spark, monkeypatch):
    """Roots with one and with two windows of 200 peptides each: the same four alternates, from few candidates."""
    dice = random.Random(12)
    peptides = ["".join(p) for p in itertools.product("ACDEF", repeat=4)]
    tallied, placed = [], []
    for start in range(1, 9):
        for peptide in dice.sample(peptides, 200):
            tallied.append((start, 4, peptide, dice.choice([1, 1, 1, 2, 2, 3, 50, 60]), 999, 0.0, dice.randint(1, 3), 99, 0.0))
    tallied += [(9, 4, "GGGG", 7, 999, 0.0, 1, 99, 0.0)]
    for start, _, peptide, *_ in dice.sample(tallied[:-1], 40):
        placed.append(("M1", peptide, start, 4))
        if dice.random() < 0.4:
            placed.append(("M1", peptide, dice.randint(1, 8), 4))
    placed += [("M1", "GGGG", 9, 4), ("M1", "WWWW", 3, 4)]
    table = spark.createDataFrame(tallied, "start int, len int, peptide string, frequency_all bigint, total_all bigint, proportion_all double,"
                                           " frequency_unique bigint, total_unique bigint, proportion_unique double")
    read, listed = [], tly._alternates_read
    monkeypatch.setattr(tly, "_alternates_read", lambda *given: read.append(listed(*given).count()) or listed(*given))
    found = tly.frequency_summary(spark.createDataFrame(placed, "protein string, peptide string, start int, length int"), table, "M1")
    expected = set()
    for root in {p[1] for p in placed}:
        windows, sums = {p[2] for p in placed if p[1] == root}, {}
        for start, _, peptide, f, _, _, u, *_ in tallied:
            if start in windows:
                sums[peptide] = (sums.get(peptide, (0, 0))[0] + f, sums.get(peptide, (0, 0))[1] + u)
        if root in sums:
            others = sorted((-f, -u, p) for p, (f, u) in sums.items() if p != root)[:4]
            expected |= {(root, root, *sums[root])} | {(root, p, -f, -u) for f, u, p in others}
    assert {(r.root_peptide, r.peptide, r.frequency_all, r.frequency_unique) for r in found.collect()} == expected
    met = sum(200 for p in set(placed) if p[2] < 9)
    assert sum(read) < met / 2


def test_annotations_follow_matches(spark, isolates, uploads):
    tallies = tly.window_tallies(isolates, tly.distinct_windows(uploads), ["protein"])
    predictions = spark.createDataFrame([("a", "MKT", 1.0, 2.0), ("a", "QQQQ", 3.0, None), ("b", "M-KT", None, 4.0)],
                                        "allele string, peptide string, netmhcpan_el_percentile double, netmhcpan_ba_percentile double")
    roots = spark.createDataFrame([("M1", "MKT", "MKT"), ("NP", "MKT", "KT"), ("NP", "MKT", "AA")], "protein string, peptide string, root string")
    once = tly.annotations_by_prediction(predictions, tallies, roots)
    assert once.count() == 3 and once.where("found is null").count() == 1
    matched = rows(tly.unfold_annotations(once).select("protein", "allele", "peptide", "root"))
    assert {r for r in matched} >= {("NP", "A", "MKT", "AA;KT"), ("NP", "B", "MKT", "AA;KT"), ("M1", "A", "MKT", "MKT")}
    everything = tly.annotate_predictions(predictions, tallies, roots)
    named = {r.protein for r in everything.collect()}
    assert everything.count() == 3 * len(named)
    assert rows(everything.where("root <> '' or frequency_all > 0")) == rows(tly.unfold_annotations(once).where("root <> '' or frequency_all > 0"))
    plan = everything._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
