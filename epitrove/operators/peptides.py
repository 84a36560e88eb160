"""Peptides in aligned coordinates, their occurrences, generation and batching."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from epitrove.functions.text import letters, ungapped
from epitrove.operators.filters import filter_frequency, within_class
from epitrove.plans.joins import lookup_join
from epitrove.plans.numbering import number_rows

# Peptides per request, generated lengths.
BATCH_SIZE = 1000
GENERATED_LENGTHS = tuple(range(8, 15))


def reference_by_protein(references: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One aligned reference per protein; of several the last by ``order`` (else the greatest)."""
    last = F.struct(*order) if order else F.col("aligned_sequence")
    return references.groupBy("protein").agg(F.max_by("aligned_sequence", last).alias("aligned_sequence"))


def align_peptides(peptides: DataFrame, references: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Raw and aligned coordinates of each peptide's first match in its protein's reference.

    Peptides without a reference or a match get NULLs; empty peptides are left out. The alignment
    columns of a reference's letters are worked out once per reference.
    """
    signs = letters(F.col("aligned_sequence"))
    columns = F.filter(F.sequence(F.lit(1), F.length("aligned_sequence")), lambda i: F.element_at(signs, i) != "-")
    prepared = reference_by_protein(references, order).where(F.length("aligned_sequence") > 0).select(
        "protein", "aligned_sequence",
        ungapped(F.col("aligned_sequence")).alias("letters"), columns.alias("columns"),
    )
    filled = peptides.where(F.length("peptide") > 0)
    placed = lookup_join(filled, prepared, "protein", "left")
    raw = F.instr(F.col("letters"), F.upper("peptide"))
    placed = placed.withColumn("start_raw", F.when(raw > 0, raw)).withColumns({
        "length_raw": F.length("peptide"),
        "start": F.get("columns", F.col("start_raw") - 1),
        "last": F.get("columns", F.col("start_raw") + F.length("peptide") - 2),
    })
    span = F.col("last") - F.col("start") + 1
    return placed.select(
        *peptides.columns, "length_raw", span.alias("length"), "start_raw", "start",
        F.substring(F.col("aligned_sequence"), F.col("start"), span).alias("peptide_aligned"),
        span.alias("aligned_length"),
    )


def _seed_length(length: Column) -> Column:
    """The largest power of two that is not above ``length``."""
    return F.pow(F.lit(2), F.length(F.bin(length)) - 1).cast("int")


def find_occurrences(sequences: DataFrame, peptides: DataFrame) -> DataFrame:
    """All matches, overlapping ones included, of each peptide in each sequence.

    Peptides are indexed by a seed, their first 1, 2, 4, 8, … letters, as many as they have. Distinct sequences
    are probed with the seed at each place, once for each seed length that occurs; what a seed hits is
    verified letter by letter. So the probes grow with the logarithm of the lengths at most, and with 8 to 14 letters
    there is one per place. A probe carries as many letters as the longest peptide has.
    """
    wanted = peptides.where(F.length("peptide") > 0).select("peptide", F.length("peptide").alias("length"))
    index = wanted.select("peptide", "length", _seed_length(F.col("length")).alias("size")).withColumn("seed", F.expr("substring(peptide, 1, size)"))
    # One short list: for each seed length the longest peptide that has it, as a subquery.
    reach = index.groupBy("size").agg(F.max("length").alias("longest"))
    sizes = reach.agg(F.collect_list(F.struct("size", "longest"))).scalar()
    filled = sequences.where(F.length("sequence") > 0).select("seq_index", "seq_id", "sequence")
    probes = filled.select("sequence").distinct().select("sequence", F.explode(F.sequence(F.lit(1), F.length("sequence"))).alias("start"))
    probes = probes.select("sequence", "start", F.inline(sizes)).select(
        "sequence", "start", F.expr("substring(sequence, start, longest)").alias("ahead"), F.expr("substring(sequence, start, size)").alias("seed"), "size"
    ).where(F.length("seed") == F.col("size"))
    found = lookup_join(probes, index, ["size", "seed"], "inner").where(F.col("ahead").startswith(F.col("peptide")))
    return lookup_join(filled, found, "sequence", "inner").select("seq_index", "seq_id", "peptide", "start", "length")


def class_one_workset(peptides: DataFrame, candidates: DataFrame, protein: str | None = None) -> DataFrame:
    """Distinct ungapped class I peptides among one protein's uploads and the top candidates.

    Without a protein the candidates have a column ``protein``, and so has the result.
    """
    name, by = F.upper(F.trim("protein")), ["protein"] if protein is None else []
    if protein is None:
        peptides, candidates = (rows.withColumn("protein", name) for rows in (peptides, candidates))
    else:
        peptides = peptides.where(name == protein.strip().upper())
    bare = F.upper(ungapped(F.col("peptide"))).alias("peptide")
    everything = peptides.select(*by, "peptide").unionByName(candidates.select(*by, "peptide")).select(*by, bare)
    return everything.where(within_class(F.col("peptide"), "I")).distinct()


def generate_peptides(
    frequencies: DataFrame, at_least: int | Column, lengths: Iterable[int] = GENERATED_LENGTHS, without: Iterable[str] = ()
) -> DataFrame:
    """All peptides that combine frequent residues over windows of the positions that have any.

    They grow as a prefix tree, one position at a time: a peptide of one length is the beginning of the next
    longer ones, so each is made once. Half-way the beginnings, of which one window can have very many, are
    spread over all tasks without the choices of their window, and look up those of the positions to come.
    """
    spark = frequencies.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = sorted(set(lengths))
    half = min(sizes[0], (sizes[-1] + 1) // 2)
    frequent = filter_frequency(frequencies, at_least, without)
    # Per position a set of residues, per window the sets of its positions: both are short.
    choices = frequent.groupBy("protein", "position").agg(F.collect_set("aminoacid").alias("choice"))
    numbered = choices.withColumn("place", F.row_number().over(Window.partitionBy("protein").orderBy("position")))

    def window(size: int) -> list[Column]:
        ahead = Window.partitionBy("protein").orderBy("position").rowsBetween(0, size - 1)
        return [F.collect_list("position").over(ahead).alias("positions"), F.collect_list("choice").over(ahead).alias("choices")]

    grown = numbered.select("protein", F.col("position").alias("start_position"), (F.col("place") + half).alias("place"), *window(half))
    grown = grown.where(F.size("choices") == half).repartition(tasks, "protein", "start_position")
    grown = grown.select("protein", "start_position", F.element_at("positions", -1).alias("end_position"), "place", "choices", F.lit("").alias("peptide"))
    for at in range(half):
        grown = grown.withColumn("residue", F.explode(F.get("choices", F.lit(at)))).withColumn("peptide", F.concat("peptide", "residue")).drop("residue")
    grown = grown.drop("choices").repartition(tasks, "protein", "start_position", "peptide")
    rest = numbered.select("protein", "place", *window(sizes[-1] - half)) if sizes[-1] > half else None
    if rest is not None:
        grown = lookup_join(grown, rest, ["protein", "place"], "left").withColumn("whole", F.lit(False))
    for at in range(sizes[-1] - half):
        # An empty residue ends a peptide that is long enough.
        onward = F.coalesce(F.get("choices", F.lit(at)), F.array().cast("array<string>"))
        if half + at >= sizes[0]:
            onward = F.when(F.col("whole"), F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), onward))
        grown = grown.withColumn("residue", F.explode(onward)).withColumns({
            "whole": F.col("whole") | (F.col("residue") == ""), "peptide": F.concat("peptide", "residue")}).drop("residue")
    length = F.length("peptide")
    end = F.coalesce(F.get("positions", length - half - 1), "end_position") if rest is not None else F.col("end_position")
    combined = grown.select("protein", length.alias("peptide_len"), "start_position", end.alias("end_position"), "peptide").where(F.col("peptide_len").isin(sizes))
    # The end grows with the start, so the smallest of both belong to the same window.
    return combined.groupBy("protein", "peptide_len", "peptide").agg(
        F.min("start_position").alias("start_position"), F.min("end_position").alias("end_position")
    ).select("protein", "peptide_len", "start_position", "end_position", "peptide")


def _with_batch(numbered: DataFrame, size: int, prefix: str, keys: Sequence[str]) -> DataFrame:
    place = F.col("n") - 1
    entry = F.concat(
        F.lit(f">{prefix}"), (place % size + 1).cast("string"), F.lit("\n"), F.col("peptide")
    )
    rows = numbered.select(*keys, F.floor(place / size).alias("chunk"), F.col("n"), entry.alias("entry"))
    # At most ``size`` entries per batch.
    return rows.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("peptides"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda e: e["entry"]), "\n").alias("fasta"),
    )


def request_batches(peptides: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Distinct peptides in order as FASTA texts of at most ``size`` entries named ``p1``, ``p2``, …"""
    numbered = number_rows(peptides.select("peptide").distinct(), ["peptide"])
    return _with_batch(numbered, size, "p", []).select((F.col("chunk") + 1).alias("batch"), "peptides", "fasta")


def request_batches_by_length(peptides: DataFrame, order: Sequence[str] = ("peptide",), size: int = BATCH_SIZE) -> DataFrame:
    """Batches that hold one peptide length each, numbered through all lengths."""
    numbered = number_rows(peptides, ["peptide_len", *order])
    # One row per length.
    lengths = numbered.groupBy("peptide_len").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("count"))
    before = Window.orderBy("peptide_len").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select(
        "peptide_len", "first",
        F.coalesce(F.sum(F.ceil(F.col("count") / size)).over(before), F.lit(0)).alias("batches_before"),
    )
    within = lookup_join(numbered, lengths, "peptide_len", "inner").withColumn("n", F.col("n") - F.col("first") + 1)
    batched = _with_batch(within, size, "", ["peptide_len", "batches_before"])
    return batched.select(
        (F.col("batches_before") + F.col("chunk") + 1).alias("batch"), "peptide_len", "peptides", "fasta"
    )


def max_overlap_depth(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest number of peptides over one position, i.e. the lanes needed to draw them apart.

    A peptide may start where another one ends. Starts and ends are summed per position first, so
    the running sum goes over positions, not over peptides.
    """
    placed = rows.where((F.col("start") > 0) & (F.col("length") > 0))
    steps = placed.select(*by, F.explode(F.array(
        F.struct(F.col("start").alias("position"), F.lit(1).alias("step")),
        F.struct((F.col("start") + F.col("length")).alias("position"), F.lit(-1).alias("step")),
    )).alias("edge")).select(*by, "edge.*")
    changes = steps.groupBy(*by, "position").agg(F.sum("step").alias("step"))
    upto = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = changes.withColumn("depth", F.sum("step").over(upto))
    return depth.groupBy(*by).agg(F.greatest(F.max("depth"), F.lit(1)).alias("lanes"))
