"""The given tables reshaped into the relations the library works on.

Orders become isolates, parts become uploaded peptides, suppliers become scanned sequences with
their predictions, customers fill the allele list. All of them grow with the tables, and so do the
distinct sequences and peptides in them. One protein has most isolates; a quarter of a protein's isolates are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from epitrove.operators.filters import IsolateFilter, filter_isolates
from epitrove.operators.frequencies import position_frequencies
from epitrove.operators.peptides import align_peptides
from epitrove.operators.tallies import (
    annotations_by_prediction, distinct_windows, top_candidates_by_window, unfold_annotations, window_roots, window_tallies,
)
from epitrove.plans.joins import inline_rows
from epitrove.plans.storage import pin

# Invented base sequences, one per protein, and four allele names.
BASES = {
    "M1": "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVK",
    "HA": "MGSSHHHHHHSSGLVPRGSHMASMTGGQQMGRGSEFELRRQACGRTRVTSKPLAWDNIYE",
    "NP": "MADEEKLPPGWEKRMSRSSGRVYYFNHITNASQWERPSGNSSSGGKNGQGEPARVRCSHL",
}
ALLELES = ["HLA-A*02:01", "HLA-A*11:01", "HLA-B*35:03", "HLA-C*04:01"]
WINDOWS = [(1, 9), (5, 9), (20, 10), (55, 9)]
NON_HUMAN = IsolateFilter(protein="M1", host_categories=("Non-human",))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values, key: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(BASES) + 1).cast("int"))


def isolates(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).withColumn("kind", F.expr("CASE o_orderkey % 7 WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END"))
    joined = joined.withColumn("base", _pick(BASES.values(), "kind")).withColumn("once", F.expr(
        "concat(substr(base, 1, CAST(o_custkey % 60 AS INT)),"
        " substr('ACDEFGHIKLMNPQRSTVWY-', CAST(floor(o_custkey / 60) AS INT) % 21 + 1, 1),"
        " substr(base, CAST(o_custkey % 60 AS INT) + 2, 60))"
    ))
    return joined.selectExpr(
        "o_orderkey AS seq_id",
        f"element_at(array({', '.join(repr(p) for p in BASES)}), CAST(kind + 1 AS INT)) AS protein",
        "concat('H', c_custkey % 5 + 1, 'N', c_custkey % 3 + 1) AS genotype",
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Homo sapiens' WHEN 'MACHINERY' THEN ' Gallus gallus '"
        " WHEN 'BUILDING' THEN NULL ELSE c_mktsegment END AS host",
        "n_name AS country",
        "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN substr(CAST(day AS STRING), 1, 4)"
        " WHEN 2 THEN substr(CAST(day AS STRING), 1, 7) WHEN 3 THEN CAST(day AS STRING)"
        " ELSE if(o_custkey % 2 = 0, 'unknown', concat(CAST(day AS STRING), if(o_custkey % 4 = 1, ' junk', 'Txx'))) END AS collection_date",
        "CAST(day AS STRING) AS release_date",
        "CASE WHEN o_orderkey % 4 = 0 THEN base WHEN o_orderkey % 16 = 1 THEN once"
        " ELSE concat(substr(once, 1, CAST(floor(o_orderkey / 4) AS INT) % 60),"
        " substr('ACDEFGHIKLMNPQRSTVWY-', CAST(floor(o_orderkey / 240) AS INT) % 21 + 1, 1),"
        " substr(once, CAST(floor(o_orderkey / 4) AS INT) % 60 + 2, 60)) END AS sequence",
    )


def references(spark: SparkSession) -> DataFrame:
    """One aligned reference per protein with a gap of two after letter 25."""
    rows = [(protein, base[:25] + "--" + base[25:]) for protein, base in BASES.items()]
    return inline_rows(spark, rows, "protein string, aligned_sequence string")


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("base", _pick(BASES.values(), "p_partkey"))
    return part.select(
        F.col("p_partkey").alias("peptide_id"), _pick(BASES, "p_partkey").alias("protein"),
        F.expr(
            "CASE WHEN p_partkey % 5 > 1 THEN substr(base, CAST(p_partkey % 60 + 1 AS INT), 8 + p_size % 7)"
            " ELSE concat(substr(base, CAST(p_partkey % 60 + 1 AS INT), 3),"
            " substr('ACDEFGHIKLMNPQRSTVWY', CAST(floor(p_partkey / 60) AS INT) % 20 + 1, 1),"
            " substr('ACDEFGHIKLMNPQRSTVWY', CAST(floor(p_partkey / 1200) AS INT) % 20 + 1, 1),"
            " substr(base, CAST(p_partkey % 60 + 6 AS INT), 3 + p_size % 7)) END"
        ).alias("peptide"),
        F.col("p_brand").alias("attribute_1"),
        F.expr("CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END").alias("attribute_2"),
        F.lit(None).cast("string").alias("attribute_3"),
    )


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return align_peptides(uploads(spark, sf), references(spark))


def scanned_sequences(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").withColumn("base", _pick(BASES.values(), "s_suppkey"))
    return supplier.select(
        (F.col("s_suppkey") + 1).cast("int").alias("seq_index"), F.col("s_name").alias("seq_id"),
        _pick(BASES, "s_suppkey").alias("protein"),
        F.expr(
            "concat(substr(base, 1, CAST(s_suppkey % 60 AS INT)),"
            " substr('ACDEFGHIKLMNPQRSTVWY', CAST(floor(s_suppkey / 60) AS INT) % 20 + 1, 1),"
            " substr(base, CAST(s_suppkey % 60 AS INT) + 2, 60))"
        ).alias("sequence"),
    )


def scan_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by sequence, window and allele under the scan page's column names.

    One row becomes some six hundred, so the few sequences are spread over all tasks first.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = scanned_sequences(spark, sf).repartition(tasks, "seq_index").select(
        "seq_index", "protein", "sequence",
        F.explode(F.array(*[F.lit(n) for n in (8, 9, 10)])).alias("len"),
    ).select("*", F.expr("explode(sequence(1, 61 - len))").alias("start")).select(
        "*", F.posexplode(F.array(*[F.lit(a) for a in ALLELES])).alias("ai", "allele")
    )
    return spread.selectExpr(
        "CASE WHEN seq_index > 1 THEN seq_index END AS `seq #`",
        "len AS `peptide length`", "protein", "allele", "substr(sequence, start, len) AS peptide", "start",
        "start + len - 1 AS `end`",
        "CASE WHEN (start * 7 + seq_index) % 97 <> 0 THEN"
        " CAST((start * 37 + len * 101 + seq_index * 53 + ai * 211) % 1000 AS DOUBLE) / 10 END AS `netmhcpan_el percentile`",
        "CAST((start * 91 + len * 17 + seq_index * 29 + ai * 307) % 1000 AS DOUBLE) / 10 AS `netmhcpan_ba percentile`",
    )


def of_both_classes(scan: DataFrame) -> DataFrame:
    """The same predictions, a third of them with the percentiles in columns of class II; some rows have class II values
    besides those of class I, which come first."""
    el, ba = F.col("netmhcpan_el percentile"), F.col("netmhcpan_ba percentile")
    turn = F.col("start") % 6
    placed = {
        "netmhcpan_el_percentile": F.when(turn.isin(1), el), "netmhcpan_el percentile": F.when(turn.isin(0, 2, 3), el),
        "netmhciipan_el_percentile": F.when(turn.isin(4), el), "netmhciipan_el percentile": F.when(turn.isin(5), el),
        "netmhcpan_ba_percentile": F.when(turn.isin(1), ba), "netmhcpan_ba percentile": F.when(turn.isin(0, 2, 3), ba),
        "netmhciipan_ba_percentile": F.when(turn.isin(4), ba), "netmhciipan_ba percentile": F.when(turn.isin(3, 5), ba + F.when(turn == 3, 1.0).otherwise(0.0)),
    }
    return scan.select(*[c for c in scan.columns if "percentile" not in c], *[value.alias(name) for name, value in placed.items()])


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (allele, peptide) under the viewer's column names."""
    return scan_predictions(spark, sf).groupBy("allele", "peptide").agg(
        F.min("netmhcpan_el percentile").alias("netmhcpan_el_percentile"),
        F.min("netmhcpan_ba percentile").alias("netmhcpan_ba_percentile"),
    )


def allele_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '  '"
        " ELSE concat(' HLA-A*', lpad(CAST(c_custkey % 90 AS STRING), 2, '0'), ':01') END AS `Class I`",
        "CASE WHEN c_custkey % 5 = 0 THEN concat('HLA-DRB1*', lpad(CAST(c_nationkey AS STRING), 2, '0'), ':01 ') END AS `Class II`",
    )


def stored_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return position_frequencies(isolates(spark, sf), ["protein"])


def live_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return position_frequencies(filter_isolates(isolates(spark, sf), NON_HUMAN))


def upload_tallies(spark: SparkSession, sf: str, placed: DataFrame | None = None) -> DataFrame:
    """Tallies of every protein over the windows of its aligned uploads."""
    placed = aligned(spark, sf) if placed is None else placed
    return window_tallies(isolates(spark, sf), distinct_windows(placed), ["protein"])


def uploads_and_tallies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Aligned uploads and the tallies of their windows, both kept because they are used more than once."""
    placed = pin(aligned(spark, sf))
    return placed, pin(upload_tallies(spark, sf, placed))


def uploads_and_candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Aligned uploads, their tallies and the top candidates."""
    placed, tallies = uploads_and_tallies(spark, sf)
    return placed, tallies, top_candidates_by_window(tallies, by=["protein"])


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with the proteins that have their peptide; what is left out has zeros and no root."""
    placed, tallies, candidates = uploads_and_candidates(spark, sf)
    return unfold_annotations(annotations_by_prediction(predictions(spark, sf), tallies, window_roots(placed, candidates)))
