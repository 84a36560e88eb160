"""Pasted peptide lists: one peptide per line, or a column of a separated file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from epitrove.functions.text import is_residues_only, strip
from epitrove.plans.joins import lookup_join
from epitrove.plans.storage import pin
from epitrove.sources.records import placed_records


def read_peptide_list(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Valid peptides in file order; ``first`` keeps the leading ones (the page keeps 100).

    The first filled line of a file decides whether it is separated, by what, and where its
    peptide column is.
    """
    lines = placed_records(spark, path).withColumn("line", strip(F.col("value"))).where("line <> ''")
    top = lines.groupBy("file").agg(F.min(F.struct("split", "row", "line")).alias("top")).select(
        "file", F.col("top.split").alias("top_split"), F.col("top.row").alias("top_row"),
        F.col("top.line").alias("top_line"),
    )
    comma, semicolon = F.contains("top_line", F.lit(",")), F.contains("top_line", F.lit(";"))
    top = top.withColumn("separator", F.when(semicolon & ~comma, ";").when(comma, ","))
    headers = F.transform(F.split("top_line", F.coalesce("separator", F.lit(","))), lambda h: F.lower(strip(h)))
    top = top.withColumn("column", F.array_position(headers, "peptide").cast("int"))

    # One row per file. It is kept, as the line it names must be the same in every later job.
    top = pin(top)
    read = lookup_join(lines, top, "file", "inner")
    is_header = (
        (F.col("column") > 0) & (F.col("split") == F.col("top_split")) & (F.col("row") == F.col("top_row"))
    )
    cells = F.split("line", F.col("separator"))
    cell = F.when(F.col("separator").isNull(), F.col("line")).otherwise(
        F.get(cells, F.greatest(F.col("column"), F.lit(1)) - 1)
    )
    peptides = read.where(~is_header).select(
        "file", "split", "row",
        F.regexp_replace(F.upper(F.coalesce(cell, F.lit(""))), r"[\s-]", "").alias("peptide"),
    ).where(is_residues_only(F.col("peptide")))
    if first is not None:
        peptides = peptides.orderBy("file", "split", "row").limit(first)
    return peptides
