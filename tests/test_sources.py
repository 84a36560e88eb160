from __future__ import annotations

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epitrove.sources import fasta, peptide_lists, results, tables
from epitrove.sources.records import placed_records


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    return str(tmp_path)


def named(frame):
    return rows(frame.drop("file", "split", "row"))


LENIENT = {
    "a": ">M1 first\r\nMKT\r\n\r\n VV \r\n> HA>x\r\nmm-\r\n>M1 first\nAA\n>\nQQ\n>empty",
    "b": "stray text\nmore\n>NP\nGG GG\n",
    "c": "only stray\n",
}
LENIENT_ROWS = [("", "QQ"), ("HA>x", "mm-"), ("M1 first", "AA"), ("M1 first", "MKTVV"), ("NP", "GGGG"), ("empty", "")]


def test_lenient_fasta(spark, tmp_path):
    assert named(fasta.read_fasta(spark, folder(tmp_path, **LENIENT))) == sorted(LENIENT_ROWS)


def test_lenient_fasta_in_small_splits(spark, tmp_path, small_splits):
    read = fasta.read_fasta(spark, folder(tmp_path, **LENIENT))
    assert read.rdd.getNumPartitions() > 4
    assert named(read) == sorted(LENIENT_ROWS)


def test_records_know_their_place(spark, tmp_path, small_splits):
    lines = [f"line {i:03d}" for i in range(200)]
    placed = placed_records(spark, folder(tmp_path, a="\n".join(lines), b="\n".join(reversed(lines))))
    for name, expected in (("a", lines), ("b", lines[::-1])):
        part = placed.where(f"file like '%{name}.txt'").orderBy("split", "row").collect()
        assert [r["value"] for r in part] == expected


def strict(spark, path):
    valid, issues = fasta.read_fasta_strict(spark, path)
    return rows(valid.drop("file")), rows(issues.drop("file"))


STRICT = {
    "a": "\n >a|x y\nMK T\nvv*\n>a other\nAC-\n>a_2\nAA\n>a_2 again\nCC\n>b#c\nDD\n>\nEE\n>|x\nFF\n>z\nMXB1\n>e\n-*\n>" + "L" * 70 + "\nGG",
    "b": "mkt\nvv\n",
    "c": "MKT\n>A\nAB",
    "d": "  \n",
}
STRICT_VALID = [
    ("a", "MKTVV"), ("a_2", "AC"), ("a_2_2", "AA"), ("a_2_3", "CC"), ("b_c", "DD"), ("seq6", "EE"), ("seq7", "FF"),
    ("L" * 64, "GG"), ("seq1", "MKTVV"),
]
STRICT_ISSUES = [("z", "invalid_chars", "1BX"), ("e", "empty_after_clean", None), ("seq1", "invalid_chars", ">B")]


def test_strict_fasta(spark, tmp_path):
    valid, issues = strict(spark, folder(tmp_path, **STRICT))
    assert valid == sorted(STRICT_VALID)
    assert issues == sorted(STRICT_ISSUES, key=str)


def test_strict_fasta_in_small_splits(spark, tmp_path, small_splits):
    valid, issues = strict(spark, folder(tmp_path, **STRICT))
    assert valid == sorted(STRICT_VALID)
    assert issues == sorted(STRICT_ISSUES, key=str)


def one_by_one(bases):
    """The naming rule as it reads: try the name, then name_2, name_3, …"""
    taken = set()
    for base in bases:
        name, k = base, 1
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
    return sorted(taken)


@pytest.mark.parametrize("bases", [
    ["a"] * 12, ["a", "a", "a_2"], ["a_2", "a", "a", "a"], ["a", "a_2", "a", "a_2", "a_2_2", "a", "b", "b"],
    ["x_3", "x", "x", "x", "x_3", "y"], ["s1", "s2", "s3"],
])
def test_repeated_names_never_clash(spark, tmp_path, bases):
    text = "\n".join(f">{base}\nAC" for base in bases)
    valid, _ = strict(spark, folder(tmp_path, a=text))
    assert [name for name, _ in valid] == one_by_one(bases)


@pytest.mark.parametrize("seed", range(4))
def test_random_names_never_clash(spark, tmp_path, seed):
    """Forms of forms, forms that come before and after the suffix they meet, numbers out of reach, and several files."""
    dice = random.Random(seed)
    pool = ["a", "a_2", "a_3", "a_4", "a_2_2", "a_2_3", "a_2_2_2", "a_02", "a_1", "b", "b_9", "b_2", "c", "c_2_2"]
    files = {name: dice.choices(pool, weights=[dice.choice([1, 5]) for _ in pool], k=dice.randint(1, 70)) for name in "xyz"}
    valid, _ = fasta.read_fasta_strict(spark, folder(tmp_path, **{name: "".join(f">{b}\nMK{'A' * n}\n" for n, b in enumerate(bases)) for name, bases in files.items()}))
    expected = []
    for bases in files.values():
        taken = set()
        for n, base in enumerate(bases):
            name, k = base, 1
            while name in taken:
                k += 1
                name = f"{base}_{k}"
            taken.add(name)
            expected.append((name, "MK" + "A" * n))
    assert rows(valid.select("id", "sequence")) == sorted(expected)


def test_a_hot_name_with_one_literal_form_is_settled_in_many_tasks(spark, tmp_path):
    bases = ["hot" if n % 3 == 0 else f"n{n}" for n in range(3_000)]
    bases[1] = "hot_2"
    valid, _ = fasta.read_fasta_strict(spark, folder(tmp_path, a="".join(f">{b}\nMK\n" for b in bases)))
    assert sorted(r.id for r in valid.collect()) == one_by_one(bases)
    assert "Pandas" not in valid._jdf.queryExecution().executedPlan().toString().replace("MapInPandas", "")


def test_peptides_csv(spark, tmp_path):
    path = folder(tmp_path, a='Peptide,PROTEIN ,"Attribute 1",My attribute 2,attribute no 3\n'
                              'acd, M1 ,"x, ""y""",ignored,\nEF,HA,,b, c \n')
    read = tables.read_peptides_csv(spark, path)
    assert read.columns == ["peptide", "protein", "attribute_1", "attribute_2", "attribute_3"]
    assert rows(read) == [("ACD", "", 'x, "y"', None, ""), ("EF", "", "", None, "c")]


def test_peptides_csv_simple(spark, tmp_path):
    path = folder(tmp_path, a='note, Peptide ,protein\n"x, acd ,M1\ny,,HA\nz,ef,NP\n')
    assert rows(tables.read_peptides_csv_simple(spark, path)) == [("ACD", "M1"), ("EF", "NP")]


def test_peptides_csv_simple_without_its_columns(spark, tmp_path):
    (tmp_path / "p").mkdir(), (tmp_path / "q").mkdir()
    without_protein = tables.read_peptides_csv_simple(spark, folder(tmp_path / "p", a="peptide\nac\n"))
    assert rows(without_protein) == [("AC", None)]
    assert rows(tables.read_peptides_csv_simple(spark, folder(tmp_path / "q", a="seq\nac\n"))) == []


def test_peptide_lists(spark, tmp_path):
    path = folder(
        tmp_path, a="\n peptide \nac-d\nxx\n e f \n", b="id;Peptide\n1; gh \n2\n3;zz\n", c="kl,1\nmn,2\n", d="a;b,c\nq;r,s\n"
    )
    read = peptide_lists.read_peptide_list(spark, path)
    assert rows(read.select("peptide")) == [("ACD",), ("EF",), ("GH",), ("KL",), ("MN",)]
    assert [r["peptide"] for r in peptide_lists.read_peptide_list(spark, path, first=3).collect()] == ["ACD", "EF", "GH"]


def test_predictions_csv(spark, tmp_path):
    path = folder(tmp_path, a="protein,allele,peptide,root,proportion_all,netmhcpan_el_percentile\n"
                              " M1 , A ,ac,ac;de,0.5,\nHA,B,gh,,bad,1.5\n")
    assert rows(tables.read_predictions_csv(spark, path)) == [
        ("HA", "B", "GH", "", 1.5, None), ("M1", "A", "AC", "AC;DE", None, 0.5)]


def test_differing_headers_are_an_error(spark, tmp_path):
    path = folder(tmp_path, a="peptide,protein\nAC,M1\n", b="protein,peptide\nM1,AC\n")
    with pytest.raises(Exception, match="header"):
        tables.read_peptides_csv(spark, path).collect()


def test_wide_predictions_need_their_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="netmhcpan_el_percentile"):
        tables.read_predictions_csv_wide(spark, folder(tmp_path, a="allele,peptide\nA,B\n"))


def test_collections_accept_their_proteins_only():
    assert tables.collection_protein("B", "IBV_NB") == tables.collection_protein("B", "NB") == "NB"
    with pytest.raises(ValueError):
        tables.collection_protein("A", "NB")
    assert tables.valid_windows([(1.9, 9), (0, 9), (3, -1), (1, 9)]) == [(1, 9)]


def test_allele_lists(spark):
    table = spark.createDataFrame([(" B ",), ("A",), (None,), (" ",), ("A",)], "`my class i` string")
    assert [r[0] for r in tables.read_allele_list(table, ["Class I"]).collect()] == ["A", "B"]
    assert tables.read_allele_list(table, ["Class II"]).count() == 0


def document(table_type="peptide_table"):
    columns = [{"name": "allele", "display_name": "Allele"}, {"name": "pct"}, {"name": "", "display_name": ""}, {"name": "pct"}]
    data = [["A", 1.5, "x", 2], ["B", None, "y", 3, "more"], {"allele": "C", "pct": "4"}, "scalar"]
    return json.dumps({"data": {"results": [
        {"type": "other"}, {"type": table_type, "table_columns": columns, "table_data": data}]}})


def test_result_documents(spark, tmp_path):
    read = results.read_prediction_json(spark, folder(tmp_path, a=document()))
    assert [r["cells"] for r in read.orderBy("row").collect()] == [
        {"Allele": "A", "col_2": "x", "pct": "2"}, {"Allele": "B", "col_2": "y", "pct": "3", "col_4": "more"},
        {"allele": "C", "pct": "4"}, {"value": "scalar"}]
    by_name = results.read_prediction_json(spark, str(tmp_path), naming="name").where("row = 0").first()["cells"]
    assert by_name == {"allele": "A", "col_2": "x", "pct": "2"}


def test_documents_without_the_table(spark, tmp_path):
    path = folder(tmp_path, a=document("else"))
    assert results.read_prediction_json(spark, path, missing="empty").count() == 0
    with pytest.raises(Exception, match="peptide_table not found"):
        results.read_prediction_json(spark, path).collect()


def test_repeated_columns_keep_the_last_cell_of_each_row(spark):
    dice = random.Random(8)
    documents, expected = [], []
    for number in range(30):
        names = [dice.choice(["a", "b", "", "col_1", "col_5", "col_9", "col_07", None]) for _ in range(dice.randint(0, 7))]
        table = [[str(dice.randint(0, 99)) for _ in range(dice.randint(0, 11))] for _ in range(4)]
        documents.append((number, json.dumps({"data": {"results": [
            {"type": "peptide_table", "table_columns": [{"name": n} for n in names], "table_data": table}]}})))
        for row, cells in enumerate(table):
            expected.append((number, row, {(names[i] if i < len(names) and names[i] else f"col_{i}"): v for i, v in enumerate(cells)}))
    found = results.parse_prediction_json(spark.createDataFrame(documents, "n int, value string"))
    assert sorted(((r.n, r.row, r.cells) for r in found.collect()), key=str) == sorted(expected, key=str)


def some_document(dice):
    """A result with tables of all kinds of cells, and texts that look like a part of one."""
    texts = ["A", "", "a,b", 'x"]', "[{", "}]", "\\", '\\",', '"table_data":[', "é,€", "line\nend", "[1,2]", '{"a":1}', '{"cut":3}']
    cell = lambda: dice.choice([dice.choice(texts), dice.randint(-9, 99), 1.50, None, True, [1, "a,]"], {"k": ["v", {"w": 2}]}])
    line = lambda: dice.choice([[cell() for _ in range(dice.randint(0, 6))], {f"c{i}": cell() for i in range(dice.randint(0, 3))}, cell()])

    def result(kind):
        parts = [("type", kind), ("table_columns", [{"name": dice.choice(["a", "b", "", "col_1"]), "more": [1, [2]]} for _ in range(dice.randint(0, 5))]),
                 ("table_data", [line() for _ in range(dice.choice([0, 1, 2, 30]))]), ("notes", {"table_data": [1, [2, 3], "x"], "in": [[[["y", 1]], 2]]})]
        return dict(dice.sample(parts, len(parts)))

    results_ = [result(kind) for kind in dice.choice([["peptide_table"], ["else", "peptide_table"], ["else"], ["peptide_table", "else", "peptide_table"]])]
    other = {"table_data": [[1], 2], "deep": [{"table_data": [["no", "rows"], ["of", "results"]]}]}
    document_ = {"other": other, "data": dict(dice.sample([("results", results_), ("other", other), ("n", 1)], 3))}
    return json.dumps(document_, indent=dice.choice([None, None, 1]), ensure_ascii=dice.random() < 0.5)


@pytest.mark.parametrize(("split", "documents"), [(150, 5), (900, 20)])
def test_long_documents_are_cut_into_the_same_rows(spark, tmp_path, small_splits, split, documents):
    dice = random.Random(split)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    texts = [some_document(dice) for _ in range(40)]
    path = folder(tmp_path, **{f"d{n}": text for n, text in enumerate(sorted(texts, key=len)[10:10 + documents])})
    whole = results.read_prediction_json(spark, path, missing="empty")
    cut = results.read_prediction_json(spark, path, missing="empty", whole_up_to=0)
    listed = lambda found: sorted((r.file, r.row, str(r.cells)) for r in found.collect())
    assert cut.dtypes == whole.dtypes
    assert listed(cut) == listed(whole) != []


def test_a_long_document_is_read_by_several_tasks(spark, tmp_path, small_splits):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    table = [[f"p{n}", n, 'said "[", twice'] for n in range(3000)]
    path = folder(tmp_path, long=json.dumps({"data": {"results": [{"type": "peptide_table", "table_columns": [{"name": "a"}, {"name": "b"}], "table_data": table}]}}))
    read = results.read_prediction_json(spark, path, whole_up_to=20000)
    assert [(r.row, r.cells) for r in read.orderBy("row").collect()] == [
        (n, {"a": f"p{n}", "b": str(n), "col_2": 'said "[", twice'}) for n in range(3000)]
    held = read.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert held < 1500


def test_long_documents_without_the_table(spark, tmp_path):
    path = folder(tmp_path, a=document("else"))
    assert results.read_prediction_json(spark, path, missing="empty", whole_up_to=0).count() == 0
    with pytest.raises(Exception, match="peptide_table not found"):
        results.read_prediction_json(spark, path, whole_up_to=0).collect()


def test_a_key_spelled_with_escapes_still_has_its_rows(spark, tmp_path):
    path = folder(tmp_path, a=document().replace("table_data", "table_d\\u0061ta"))
    whole, cut = (results.read_prediction_json(spark, path, whole_up_to=n) for n in (1 << 20, 0))
    assert sorted((r.row, str(r.cells)) for r in cut.collect()) == sorted((r.row, str(r.cells)) for r in whole.collect()) != []


def test_only_forms_that_suffixes_can_meet_are_looked_at(spark):
    from epitrove.sources.fasta import _forms

    names = [("f", f"EPI_ISL_{n}", 1, n) for n in range(1, 3001)] + [
        ("f", name, entries, 0) for name, entries in (("EPI", 2), ("EPI_2", 1), ("EPI_9", 1), ("a_2_2", 1), ("a_2", 1), ("a", 3))]
    found = {(r.parent, r.number) for r in _forms(spark.createDataFrame(names, "file string, base string, entries long, first long")).collect()}
    assert found == {("EPI", 2), ("a", 2), ("a_2", 2)}


def test_names_are_those_of_one_pass_through_the_file(spark, tmp_path):
    import random

    chance = random.Random(6)
    made = [chance.choice(["a", "a_2", "a_3", "a_2_2", "b", "b_02", "b_1", "c", "c_7"]) for _ in range(60)]
    folder_ = folder(tmp_path, names="".join(f">{n}\nMK\n" for n in made))
    used, tried, expected = set(), {}, []
    for base in made:
        number = tried.get(base, 1)
        name = base if number == 1 else f"{base}_{number}"
        while name in used:
            number += 1
            name = f"{base}_{number}"
        tried[base] = number
        used.add(name)
        expected.append(name)
    valid, _ = fasta.read_fasta_strict(spark, folder_)
    assert sorted(r.id for r in valid.collect()) == sorted(expected)


def test_workers_find_the_package_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as entry\n"
        "from epitrove.session import local_session\n"
        "spark = local_session('2')\n"
        "for name in ('read_fasta', 'read_peptide_list', 'align_references'):\n"
        "    print(name, entry.queries()[name](spark, '/root/testdata/sf0.001').count())\n"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 6
