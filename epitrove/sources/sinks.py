"""Writers: slim Parquet, the by-protein layout, CSV and FASTA."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from epitrove.functions.schema import quoted, require_columns
from epitrove.functions.text import strip
from epitrove.plans.numbering import number_rows

# Columns kept by the slim tables and their types.
SLIM_PREDICTION_COLUMNS = ("allele", "peptide", "netmhcpan_el_percentile", "netmhcpan_ba_percentile")
SLIM_PEPTIDE_TYPES = {
    "seq #": "int",
    "peptide length": "smallint",
    "allele": "string",
    "peptide": "string",
    "start": "int",
    "end": "int",
    "netmhcpan_el percentile": "float",
    "netmhcpan_ba percentile": "float",
}
ROWS_PER_FILE = 2_000_000
SLIM_ROWS_PER_GROUP = 1_000_000
ROWS_PER_GROUP = 500_000
_GROUP_ROWS = "parquet.block.row.count.limit"
FASTA_WIDTH = 60


def _two_places(percentile: Column) -> Column:
    """Half-even rounding of the scaled double, stored as float.

    ``bround`` works on the decimal text, where 0.295 is a tie; its hundredfold as a double is not.
    """
    return (F.rint(percentile.cast("double") * 100) / 100).cast("float")


def slim_predictions(predictions: DataFrame) -> DataFrame:
    require_columns(predictions, SLIM_PREDICTION_COLUMNS)
    allele, peptide, *percentiles = SLIM_PREDICTION_COLUMNS
    return predictions.select(allele, peptide, *[_two_places(F.col(p)).alias(p) for p in percentiles])


def slim_peptide_table(table: DataFrame) -> DataFrame:
    require_columns(table, SLIM_PEPTIDE_TYPES)
    return table.select(*[
        (_two_places(quoted(name)) if kind == "float" else quoted(name).cast(kind)).alias(name)
        for name, kind in SLIM_PEPTIDE_TYPES.items()
    ])


def write_slim(table: DataFrame, path: str, rows_per_group: int = SLIM_ROWS_PER_GROUP) -> None:
    """ZSTD Parquet; Parquet's own dictionary pages cover the repeated strings."""
    table.write.mode("overwrite").option("compression", "zstd").option(_GROUP_ROWS, rows_per_group).parquet(path)


def partition_by_protein(
    table: DataFrame, path: str, only: Iterable[str] | None = None, rows_per_file: int = ROWS_PER_FILE,
    rows_per_group: int = ROWS_PER_GROUP,
) -> None:
    """Write ``protein=…/`` folders, replacing the proteins present in ``table`` and no others.

    The rebalance hint gathers each protein's rows into few files and splits a protein that is
    too large for one task.
    """
    require_columns(table, ["protein"])
    wanted = [name.strip() for name in only or [] if name.strip()]
    if wanted:
        table = table.where(F.col("protein").isin(wanted))
    (
        table.hint("rebalance", F.col("protein"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .option(_GROUP_ROWS, rows_per_group)
        .partitionBy("protein")
        .parquet(path)
    )


def append_predictions(rows: DataFrame, path: str) -> None:
    """Add a batch of results to a growing CSV folder; every part file has the header."""
    rows.write.mode("append").csv(path, header=True, quote='"', escape='"')


def _plain_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def quoted_cells(rows: DataFrame) -> DataFrame:
    """All columns as text with line breaks turned to spaces."""
    return rows.select(*[
        F.regexp_replace(_plain_text(quoted(c)), r"\r?\n", " ").alias(c) for c in rows.columns
    ])


def export_csv_quoted(rows: DataFrame, path: str) -> None:
    """Every cell in quotes, quotes doubled, CRLF line ends."""
    quoted_cells(rows).write.mode("overwrite").csv(
        path, header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def union_of_columns(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables under the union of their columns, in order of first appearance."""
    combined, *rest = tables
    for table in rest:
        combined = combined.unionByName(table, allowMissingColumns=True)
    return combined


def minimal_cell(value: Column) -> Column:
    """A CSV cell quoted only when it holds a comma, a quote or a line break."""
    text = _plain_text(value)
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), doubled).otherwise(text)


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", *[minimal_cell(quoted(c)) for c in rows.columns]).alias("line"))


def export_csv_minimal(tables: Sequence[DataFrame], path: str) -> None:
    """The union of the tables as CSV; the header line is a column name, so each part has it."""
    rows = union_of_columns(tables)
    header = ",".join(
        '"' + c.replace('"', '""') + '"' if any(ch in c for ch in '",\n') else c for c in rows.columns
    )
    # The lines are ready-made: the writer must not quote them again.
    csv_lines(rows).withColumnRenamed("line", header).write.mode("overwrite").csv(
        path, header=True, quote="", sep="\u0001", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def wrapped(sequence: Column, width: int = FASTA_WIDTH) -> Column:
    return F.regexp_replace(F.regexp_replace(sequence, r"\s+", ""), f"(.{{{width}}})(?=.)", "$1\n")


def fasta_records(
    rows: DataFrame, header: str, sequence: str, width: int = FASTA_WIDTH, order: Sequence[str] | None = None
) -> DataFrame:
    """Rendered entries. With ``order`` (a unique key) a missing header becomes ``seq_`` and its number."""
    title = F.col(header).cast("string")
    if order is not None:
        rows = number_rows(rows, order, "__n")
        title = F.coalesce(title, F.concat(F.lit("seq_"), F.col("__n").cast("string")))
    title = F.regexp_replace(F.coalesce(title, F.lit("")), "^>", "")
    body = wrapped(F.coalesce(F.col(sequence), F.lit("")), width)
    return rows.select(F.concat(F.lit("> "), title, F.lit("\n"), body).alias("record"))


def export_fasta(rows: DataFrame, path: str, header: str, sequence: str, width: int = FASTA_WIDTH,
                 order: Sequence[str] | None = None) -> None:
    fasta_records(rows, header, sequence, width, order).write.mode("overwrite").text(path)


def strict_fasta_records(valid: DataFrame, width: int | None = None) -> DataFrame:
    """``>id`` entries of checked sequences, wrapped only on request."""
    body = F.col("sequence") if width is None else wrapped(F.col("sequence"), width)
    return valid.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), body).alias("record"))
