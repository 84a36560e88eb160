from __future__ import annotations

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epitrove.operators import peptides as pep


def test_alignment_in_gapped_coordinates(spark):
    peptides = spark.createDataFrame([
        (1, "M1", "KTA"), (2, "M1", "mk"), (3, "M1", "AYI"), (4, "M1", "QQ"), (5, "HA", "MK"), (6, "M1", ""), (7, "M1", "I")],
        "n int, protein string, peptide string")
    references = spark.createDataFrame([("M1", "old", 1), ("M1", "-MKT--AY-I", 2), ("NP", "", 1)], "protein string, aligned_sequence string, line int")
    placed = pep.align_peptides(peptides, references, ["line"]).orderBy("n").collect()
    assert [(r["n"], r["start_raw"], r["start"], r["length"], r["peptide_aligned"], r["length_raw"]) for r in placed] == [
        (1, 2, 3, 5, "KT--A", 3), (2, 1, 2, 2, "MK", 2), (3, 4, 7, 4, "AY-I", 3), (4, None, None, None, None, 2),
        (5, None, None, None, None, 2), (7, 6, 10, 1, "I", 1)]


def test_all_overlapping_occurrences(spark):
    sequences = spark.createDataFrame([(1, "s1", "AAAA"), (2, "s2", "GAAG"), (3, "s3", ""), (4, "s4", None)], "seq_index int, seq_id string, sequence string")
    peptides = spark.createDataFrame([("AA",), ("AAA",), ("G",), ("",), ("AAAAAAAA",)], "peptide string")
    assert rows(pep.find_occurrences(sequences, peptides)) == [
        (1, "s1", "AA", 1, 2), (1, "s1", "AA", 2, 2), (1, "s1", "AA", 3, 2), (1, "s1", "AAA", 1, 3), (1, "s1", "AAA", 2, 3),
        (2, "s2", "AA", 2, 2), (2, "s2", "G", 1, 1), (2, "s2", "G", 4, 1)]
    assert pep.find_occurrences(sequences, peptides.where("false")).count() == 0


def generated_by_hand(cells, lengths):
    first = {}
    for protein in {c[0] for c in cells}:
        choices = {}
        for p, position, residue in cells:
            if p == protein:
                choices.setdefault(position, set()).add(residue)
        positions = sorted(choices)
        for size in lengths:
            for at in range(len(positions) - size + 1):
                window = positions[at:at + size]
                for letters in itertools.product(*(choices[p] for p in window)):
                    first.setdefault((protein, size, "".join(letters)), (window[0], window[-1]))
    return sorted((p, n, s, e, text) for (p, n, text), (s, e) in first.items())


def test_generated_peptides_are_all_combinations(spark):
    dice = random.Random(1)
    cells = {(protein, position, dice.choice("ACDE")) for protein in ("M1", "NP") for position in (1, 2, 3, 5, 6, 9) for _ in range(3)}
    cells |= {("M1", 2, "A"), ("M1", 3, "A"), ("NP", 1, "A"), ("NP", 2, "A")}
    seen = [(*c, 10) for c in cells] + [("M1", 2, "-", 99), ("M1", 4, "W", 9), ("HA", 1, "C", 50), ("HA", 2, "C", 50)]
    frequencies = spark.createDataFrame(seen, "protein string, position int, aminoacid string, frequency_all bigint")
    made = pep.generate_peptides(frequencies, 10, (2, 3), {"HA"})
    assert rows(made) == sorted(generated_by_hand(cells, (2, 3)), key=lambda r: tuple((True, str(v)) for v in r))
    assert pep.generate_peptides(frequencies, 10, (7,), {"HA"}).count() == 0


def lanes_by_hand(intervals):
    ends = []
    for start, length in sorted(intervals):
        free = next((i for i, end in enumerate(ends) if start >= end), None)
        if free is None:
            ends.append(0)
            free = len(ends) - 1
        ends[free] = start + length
    return max(1, len(ends))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_depth_is_the_number_of_lanes(spark, seed):
    dice = random.Random(seed)
    intervals = [(dice.randint(1, 40), dice.randint(1, 9)) for _ in range(60)]
    table = spark.createDataFrame([("M1", *i) for i in intervals] + [("HA", 1, 3), ("HA", 4, 2), ("HA", None, None)],
                                  "protein string, start int, length int")
    assert rows(pep.max_overlap_depth(table, ["protein"])) == [("HA", 1), ("M1", lanes_by_hand(intervals))]


def test_batches_hold_all_peptides_in_order(spark):
    peptides = spark.range(25).select(F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("peptide"))
    batches = pep.request_batches(peptides.unionAll(peptides), 10).orderBy("batch").collect()
    assert [r["peptides"] for r in batches] == [10, 10, 5]
    assert batches[2]["fasta"] == "\n".join(f">p{i + 1}\nP2{i}" for i in range(5))


def test_batches_by_length_are_numbered_through(spark):
    peptides = spark.createDataFrame([(text, len(text)) for text in ("AA", "CC", "DD", "AAA", "CCC")], "peptide string, peptide_len int")
    batches = pep.request_batches_by_length(peptides, size=2).orderBy("batch").collect()
    assert [(r["batch"], r["peptide_len"], r["fasta"]) for r in batches] == [
        (1, 2, ">1\nAA\n>2\nCC"), (2, 2, ">1\nDD"), (3, 3, ">1\nAAA\n>2\nCCC")]


def test_class_one_workset(spark):
    peptides = spark.createDataFrame([("m1", "ac-defghi"), ("M1", "ACD"), ("HA", "GGGGGGGGG")], "protein string, peptide string")
    candidates = spark.createDataFrame([("ACDEFGHI",), ("ACDEFGHIKLMN--",), ("A" * 15,)], "peptide string")
    assert rows(pep.class_one_workset(peptides, candidates, "M1")) == [("ACDEFGHI",), ("ACDEFGHIKLMN",)]


def test_occurrences_of_all_lengths_by_hand(spark):
    dice = random.Random(9)
    sequences = [(n, f"s{n}", "".join(dice.choices("AC", k=dice.randint(0, 40)))) for n in range(30)] + [(99, "again", "ACACAC"), (98, "twice", "ACACAC")]
    peptides = [("".join(dice.choices("AC", k=k)),) for k in (1, 2, 3, 4, 5, 7, 8, 9, 14) for _ in range(2)] + [("ACA",), ("ACA",)]
    expected = [(n, name, p, at + 1, len(p)) for n, name, text in sequences for (p,) in peptides for at in range(len(text)) if text.startswith(p, at)]
    found = pep.find_occurrences(spark.createDataFrame(sequences, "seq_index int, seq_id string, sequence string"), spark.createDataFrame(peptides, "peptide string"))
    assert rows(found) == sorted(expected, key=lambda r: tuple((True, str(v)) for v in r))


@pytest.mark.parametrize("lengths", [(8, 9, 10, 11, 12, 13, 14), (1,), (2, 5), (3, 4)])
def test_generated_lengths_share_one_tree(spark, lengths):
    dice = random.Random(len(lengths))
    cells = {("M1", position, residue) for position in range(1, 18) if position != 9 for residue in dice.sample("ACDE", dice.choice([1, 1, 1, 2]))}
    table = spark.createDataFrame([(*c, 10) for c in cells], "protein string, position int, aminoacid string, frequency_all bigint")
    made = pep.generate_peptides(table, 10, lengths)
    assert rows(made) == sorted(generated_by_hand(cells, lengths), key=lambda r: tuple((True, str(v)) for v in r))
    explodes = made._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")
    assert explodes <= lengths[-1]
