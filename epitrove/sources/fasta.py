"""FASTA readers: a lenient one and one that names and checks every entry."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from epitrove.functions.text import RESIDUES, is_residues_only, strip
from epitrove.plans.joins import lookup_join
from epitrove.plans.numbering import number_rows_within
from epitrove.plans.storage import pin
from epitrove.sources.records import placed_records

ENTRY_BREAK = "\n>"
ID_LENGTH = 64
_RENAMED = "file string, split long, row long, id string"


def _is_first() -> Column:
    return (F.col("split") == 0) & (F.col("row") == 0)


def _entry_text() -> Column:
    """The record without the ``>`` that only the first record of a file still carries."""
    return F.when(_is_first(), F.regexp_replace("value", r"^\s*>", "")).otherwise(F.col("value"))


def _header_and_body(text: Column) -> tuple[Column, Column]:
    return F.regexp_extract(text, r"\A([^\n]*)", 1), F.regexp_replace(text, r"\A[^\n]*\n?", "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Protein (header) and raw sequence of every entry; text before a file's first header is dropped."""
    records = placed_records(spark, path, ENTRY_BREAK).where(~_is_first() | F.col("value").startswith(">"))
    header, body = _header_and_body(_entry_text())
    return records.select(
        "file", "split", "row",
        strip(header).alias("protein"),
        F.regexp_replace(body, r"\s+", "").alias("raw_sequence"),
    )


def _entry_numbers(entries: DataFrame) -> DataFrame:
    """Number the entries of each file by adding up the sizes of the splits before."""
    splits = entries.groupBy("file", "split").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("first"))
    # One row per split of a file.
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "split", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first") + 1).alias("offset")
    )
    return lookup_join(entries, offsets, ["file", "split"], "inner").withColumn("index", F.col("row") + F.col("offset"))


def _forms(counted: DataFrame) -> DataFrame:
    """``file``, ``parent``, ``number``, ``base``, ``met``: names of the form ``parent_number`` that the parent's suffixes can meet.

    ``counted`` has the entries of each base name and the index of the first. Suffixes of a name go up to its entries
    and the names of its form, so one with a larger number is not touched.
    """
    form = r"^(.*)_([1-9]\d*)$"
    formed = counted.select("file", "base", F.col("first").alias("met"), F.regexp_extract("base", form, 1).alias("parent"),
                            F.regexp_extract("base", form, 2).try_cast("long").alias("number")).where("number >= 2")
    taken = formed.groupBy("file", "parent").agg(F.count(F.lit(1)).alias("taken"))
    reach = counted.select("file", F.col("base").alias("parent"), "entries").join(taken, ["file", "parent"])
    reach = pin(reach.select("file", "parent", (F.col("entries") + F.col("taken")).alias("last")))
    return lookup_join(formed, reach, ["file", "parent"], "inner").where("number <= last").drop("last")


_SETTLED = "array<struct<number: long, skipped: boolean, turn: long>>"


def _settled(forms: pa.Array) -> pa.Array:
    """Of a name's forms (number, before), by number: is it skipped, and if not, which of the name's entries to rename gets it?

    ``before`` counts the entries to rename before the form's own first entry. A form is skipped if that comes
    before the entry whose turn it is.
    """
    out = []
    for row in forms.to_pylist():
        skipped, found = 0, []
        for form in row:
            turn = form["number"] - 1 - skipped
            skips = turn > form["before"]
            found.append({"number": form["number"], "skipped": skips, "turn": turn})
            skipped += skips
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("number", pa.int64()), ("skipped", pa.bool_()), ("turn", pa.int64())])))


def _renamed(names: DataFrame) -> DataFrame:
    """Entries whose id is not their base name: ``(file, split, row, id)``.

    Entries of a name that is taken get the suffixes ``_2``, ``_3``, … in file order, without those that are taken
    by then. Only a form ``name_k`` of the name can be in the way, or lose its own name; so names are settled from
    the shorter to the longer ones, all of one depth at once. Per name only the list of its forms is gathered, never
    its entries: these get their turn, and the number of skipped suffixes before it, by prefix sums.
    """
    counted = pin(names.groupBy("file", "base").agg(F.count(F.lit(1)).alias("entries"), F.min("index").alias("first")))
    key = ["file", "base"]
    if counted.where("entries > 1").isEmpty():
        return names.sparkSession.createDataFrame([], _RENAMED)
    forms = pin(_forms(counted))
    # Entries before each form's first one: places in the merged order less places among the forms.
    parents = pin(forms.select("file", F.col("parent").alias("base")).distinct())
    entries = lookup_join(names, parents, key, "left_semi").select(*key, "index", F.lit(None).cast("long").alias("number"))
    meetings = forms.select("file", F.col("parent").alias("base"), F.col("met").alias("index"), "number")
    before = number_rows_within(entries.unionByName(meetings), key, ["index", "number"], "both").where("number IS NOT NULL")
    before = pin(number_rows_within(before, key, ["index", "number"], "among").select(*key, "number", (F.col("both") - F.col("among")).alias("before")))
    concerned = counted.where("entries > 1").select(*key).unionByName(parents).distinct()
    depth = lookup_join(lookup_join(counted, pin(concerned), key, "inner"), forms.select(*key), key, "left_anti")
    depth = pin(depth.withColumn("lost", F.lit(False)))
    settled, skips = [], []
    while not depth.isEmpty():
        settled.append(depth)
        # All entries of a name that was lost are renamed, else all but the first.
        kept = F.when(F.col("lost"), 0).otherwise(1)
        active = depth.where((F.col("entries") > 1) | F.col("lost")).select(*key, "entries", kept.alias("kept"))
        listed = before.join(active, key).groupBy(*key, "entries", "kept").agg(
            F.array_sort(F.collect_list(F.struct("number", F.greatest(F.col("before") - F.col("kept"), F.lit(0)).alias("before")))).alias("forms"))
        turns = pin(listed.select(*key, (F.col("entries") - F.col("kept")).alias("renamed"), F.inline(F.arrow_udf(_settled, _SETTLED)("forms"))))
        skips.append(turns.where("skipped").select(*key, "number", "turn"))
        lost = turns.where("NOT skipped AND turn <= renamed").select("file", F.concat_ws("_", "base", F.col("number").cast("string")).alias("base"), F.lit(True).alias("taken"))
        below = forms.select("file", F.col("parent").alias("base"), F.col("base").alias("form")).join(depth.select(*key), key).select("file", F.col("form").alias("base"))
        depth = pin(counted.join(below, key).join(lost, key, "left").select(*key, "entries", "first", F.coalesce("taken", F.lit(False)).alias("lost")))
    names_lost = _together(settled).where((F.col("entries") > 1) | F.col("lost")).select(*key, "lost")
    numbered = number_rows_within(lookup_join(names, pin(names_lost), key, "inner"), key, ["index"], "k")
    turned = numbered.withColumn("turn", F.col("k") - F.when(F.col("lost"), 0).otherwise(1)).where("turn > 0")
    # A skipped suffix moves up the entries from the turn it would have had; it stands before that entry.
    entries = turned.select(*key, "turn", "split", "row", F.lit(1).alias("entry"), F.lit(0).cast("long").alias("number"))
    skipped = _together(skips).select(*key, "turn", F.lit(0).cast("long").alias("split"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("entry"), "number")
    merged = number_rows_within(entries.unionByName(skipped), key, ["turn", "entry", "number", "split", "row"], "n").where("entry = 1")
    return merged.select("file", "split", "row", F.concat_ws("_", "base", (F.col("n") + 1).cast("string")).alias("id"))


def _together(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


def read_fasta_strict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Checked entries ``(file, id, sequence)`` and the issues ``(file, id, type, chars)``.

    A file that does not open with ``>`` is one bare sequence named ``seq1``.
    """
    records = pin(
        placed_records(spark, path, ENTRY_BREAK).where(~_is_first() | (strip(F.col("value")) != ""))
    )
    bare_files = records.where(_is_first() & ~strip(F.col("value")).startswith(">")).select("file")
    fasta = lookup_join(records, bare_files, "file", "left_anti")

    header, body = _header_and_body(_entry_text())
    token = F.element_at(F.split(strip(header), r"\s+|\|", 2), 1)
    entries = fasta.select(
        "file", "split", "row", token.alias("token"),
        F.upper(F.regexp_replace(body, r"[\s*-]", "")).alias("sequence"),
    )
    named = F.when(F.col("token") != "", F.col("token")).otherwise(
        F.concat(F.lit("seq"), F.col("index").cast("string"))
    )
    entries = _entry_numbers(entries).withColumn(
        "base", F.substring(F.regexp_replace(named, "[^A-Za-z0-9_.-]", "_"), 1, ID_LENGTH)
    )
    place = ["file", "split", "row"]
    renamed = pin(_renamed(entries.select(*place, "base", "index")))
    named = lookup_join(entries, renamed, place, "left").select(
        "file", F.coalesce("id", "base").alias("id"), "sequence"
    )

    # A bare file whose text goes on after a line starting with ">" is one sequence holding that sign.
    bare_text = lookup_join(records, bare_files, "file", "left_semi").withColumn(
        "cleaned", F.upper(F.regexp_replace("value", r"[\s*-]", ""))
    )
    letters = bare_text.select("file", F.explode(_strange_letters(F.col("cleaned"))).alias("letter"))
    strange = letters.groupBy("file").agg(F.collect_set("letter").alias("found"))
    parts = bare_text.groupBy("file").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.when(_is_first(), F.col("cleaned"))).alias("sequence")
    )
    broken = F.col("parts") > 1
    found = F.coalesce("found", F.array().cast("array<string>"))
    bare_named = parts.join(strange, "file", "left").select(
        "file", F.lit("seq1").alias("id"),
        F.when(broken, F.lit(">")).otherwise(F.col("sequence")).alias("sequence"),
        F.array_sort(F.when(broken, F.array_union(found, F.array(F.lit(">")))).otherwise(found)).alias("strange"),
    )
    checked = named.withColumn("strange", F.array_sort(_strange_letters(F.col("sequence")))).unionByName(bare_named)

    valid = checked.where(is_residues_only(F.col("sequence"))).select("file", "id", "sequence")
    empty = F.col("sequence") == ""
    issues = checked.where(~is_residues_only(F.col("sequence"))).select(
        "file", "id",
        F.when(empty, "empty_after_clean").otherwise("invalid_chars").alias("type"),
        F.when(~empty, F.array_join("strange", "")).alias("chars"),
    )
    return valid, issues


def _strange_letters(sequence: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(sequence, F.lit(f"([^{RESIDUES}])"), 1))
