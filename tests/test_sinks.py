from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import rows
from pyspark.sql import functions as F

from epitrove.sources import sinks


def written(path, pattern="part-*"):
    return "".join(p.read_bytes().decode() for p in sorted(Path(path).glob(pattern)))


def test_rounding_is_that_of_arrow(spark):
    values = [i / 1000 for i in range(0, 20001, 5)] + [0.295, 1.115, 0.285, 99.995]
    frame = spark.createDataFrame([("A", "P", v, None) for v in values], "allele string, peptide string, "
                                  "netmhcpan_el_percentile double, netmhcpan_ba_percentile double").coalesce(1)
    ours = [r[0] for r in sinks.slim_predictions(frame).select("netmhcpan_el_percentile").collect()]
    theirs = pc.cast(pc.round(pa.array(values), ndigits=2), pa.float32()).to_pylist()
    assert ours == theirs


def test_slim_tables_need_their_columns(spark):
    with pytest.raises(ValueError, match="peptide length"):
        sinks.slim_peptide_table(spark.createDataFrame([(1,)], "`seq #` int"))


def test_slim_peptide_table_types(spark, tmp_path):
    wide = spark.createDataFrame(
        [(1, 9, "A", "P", 3, 11, 0.125, 1.0, "extra")],
        "`seq #` bigint, `peptide length` bigint, allele string, peptide string, start bigint, `end` bigint, "
        "`netmhcpan_el percentile` double, `netmhcpan_ba percentile` double, other string")
    sinks.write_slim(sinks.slim_peptide_table(wide), str(tmp_path / "slim"))
    assert [kind for _, kind in spark.read.parquet(str(tmp_path / "slim")).dtypes] == list(sinks.SLIM_PEPTIDE_TYPES.values())


def test_only_written_proteins_are_replaced(spark, tmp_path):
    path = str(tmp_path / "isolates")
    table = spark.createDataFrame([("M1", 1), ("HA", 2), ("NP", 3)], "protein string, n int")
    sinks.partition_by_protein(table, path)
    sinks.partition_by_protein(table.withColumn("n", F.col("n") * 10), path, only=["HA", " "])
    assert rows(spark.read.parquet(path).select("protein", "n")) == [("HA", 20), ("M1", 1), ("NP", 3)]
    assert sorted(p.name for p in Path(path).glob("protein=*")) == ["protein=HA", "protein=M1", "protein=NP"]


def test_files_hold_a_limited_number_of_rows(spark, tmp_path):
    path = str(tmp_path / "isolates")
    sinks.partition_by_protein(spark.range(100).withColumn("protein", F.lit("M1")), path, rows_per_file=30)
    assert len(list(Path(path).glob("protein=M1/*.parquet"))) >= 4


def test_row_groups_hold_a_limited_number_of_rows(spark, tmp_path):
    import pyarrow.parquet as pq

    table = spark.range(0, 1000, 1, 1).withColumn("protein", F.lit("M1"))
    sinks.write_slim(table, str(tmp_path / "slim"), rows_per_group=300)
    sinks.partition_by_protein(table, str(tmp_path / "parts"), rows_per_group=400)
    for pattern, most in (("slim/*.parquet", 300), ("parts/protein=M1/*.parquet", 400)):
        for file in tmp_path.glob(pattern):
            meta = pq.ParquetFile(file).metadata
            assert meta.num_rows <= most or meta.num_row_groups > 1
            assert all(meta.row_group(n).num_rows <= most for n in range(meta.num_row_groups))


def test_quoted_csv(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'say "x"', None), (2, " two\r\nlines\n", "")], "n int, `a b` string, c string").coalesce(1)
    sinks.export_csv_quoted(frame, str(tmp_path / "csv"))
    assert written(tmp_path / "csv") == '"n","a b","c"\r\n"1","say ""x""",""\r\n"2"," two lines ",""\r\n'


def test_minimal_csv(spark, tmp_path):
    first = spark.createDataFrame([(1, "a,b"), (2, 'q"r')], "n int, text string").coalesce(1)
    second = spark.createDataFrame([(3, " plain ")], "n int, more string").coalesce(1)
    sinks.export_csv_minimal([first, second], str(tmp_path / "csv"))
    parts = [p.read_text() for p in sorted((tmp_path / "csv").glob("part-*"))]
    assert "".join(p.split("\n", 1)[1] for p in parts) == '1,"a,b",\n2,"q""r",\n3,, plain \n'
    assert {p.split("\n", 1)[0] for p in parts} == {"n,text,more"}


def test_appended_results_accumulate(spark, tmp_path):
    path = str(tmp_path / "results")
    for number in (1, 2):
        sinks.append_predictions(spark.createDataFrame([(f'a,"{number}"', number)], "name string, n int"), path)
    assert rows(spark.read.csv(path, header=True, escape='"')) == [('a,"1"', "1"), ('a,"2"', "2")]


def test_fasta_text(spark, tmp_path):
    frame = spark.createDataFrame([(1, ">M1", "AB" * 31 + " C"), (2, None, None), (3, "x", "D" * 60)], "k int, name string, seq string")
    records = [r[0] for r in sinks.fasta_records(frame, "name", "seq", order=["k"]).orderBy("record").collect()]
    assert records == ["> M1\n" + "AB" * 30 + "\nABC", "> seq_2\n", "> x\n" + "D" * 60]
    sinks.export_fasta(frame.where("k = 3"), str(tmp_path / "fasta"), "name", "seq", width=25)
    assert written(tmp_path / "fasta") == "> x\n" + "D" * 25 + "\n" + "D" * 25 + "\n" + "D" * 10 + "\n"


def test_strict_fasta_text(spark):
    valid = spark.createDataFrame([("a", "ACDE")], "id string, sequence string")
    assert sinks.strict_fasta_records(valid).first()[0] == ">a\nACDE"
    assert sinks.strict_fasta_records(valid, 3).first()[0] == ">a\nACD\nE"
