"""Prediction results delivered as JSON documents, one document per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epitrove.plans.joins import lookup_join
from epitrove.plans.storage import pin
from epitrove.sources.long_documents import cut_long_documents

# Up to so many bytes a document is parsed as one text.
WHOLE_BYTES = 8 << 20
TABLE_TYPE = "peptide_table"
_DOCUMENT = (
    "data struct<results: array<struct<type: string, "
    "table_columns: array<struct<name: string, display_name: string>>, table_data: array<string>>>>"
)


def _column_names(naming: str) -> Column:
    def blank_to_null(text: Column) -> Column:
        return F.when(text != "", text)

    def name(column: Column) -> Column:
        if naming == "name":
            return column["name"]
        if naming == "filled":
            return F.coalesce(blank_to_null(column["display_name"]), column["name"])
        return F.coalesce(column["display_name"], column["name"])

    return F.transform(
        "found.table_columns",
        lambda c, i: F.coalesce(blank_to_null(name(c)), F.concat(F.lit("col_"), i.cast("string"))),
    )


_NEVER = (1 << 31) - 1


def _again(names: str) -> Column:
    """Per name the place where it occurs next; names are sorted once for this, with their places."""
    placed = F.array_sort(F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("at"))))

    def following(pair: Column, k: Column) -> Column:
        later = F.get(placed, k + 1)
        # A cell beyond the names is called after its place, which can be a name, too.
        beyond = F.regexp_extract(pair["name"], r"^col_(0|[1-9]\d*)$", 1).try_cast("int")
        return F.when(later["name"] == pair["name"], later["at"]).when(beyond >= F.size(names), beyond).otherwise(F.lit(_NEVER))

    found = F.transform(placed, lambda pair, k: F.struct(pair["at"].alias("at"), following(pair, k).alias("again")))
    return F.transform(F.array_sort(found), lambda pair: pair["again"])


def parse_prediction_json(
    documents: DataFrame, column: str = "value", naming: str = "display", missing: str = "error"
) -> DataFrame:
    """One row per table row with ``cells``, a map from column name to text.

    ``naming``: ``display`` takes the display name unless it is absent, ``filled`` also skips an
    empty one, ``name`` ignores it. ``missing``: a document without the table is an ``error`` or
    ``empty``. Which columns share a name is worked out once per document.
    """
    carried = [c for c in documents.columns if c != column]
    named = _named_tables(documents, column, naming, missing)
    return _with_cells(named.select(*carried, "names", "again", F.posexplode("found.table_data").alias("row", "text")), carried)


def _named_tables(documents: DataFrame, column: str, naming: str, missing: str) -> DataFrame:
    """The table of each document with its columns' names and where they come again."""
    carried = [c for c in documents.columns if c != column]
    results = F.from_json(column, _DOCUMENT)["data"]["results"]
    table = F.get(F.filter(results, lambda r: r["type"] == TABLE_TYPE), 0)
    found = documents.select(*carried, table.alias("found"))
    if missing == "error":
        complaint = F.raise_error(F.lit(f"{TABLE_TYPE} not found in result"))
        found = found.withColumn("found", F.when(F.col("found").isNull(), complaint).otherwise(F.col("found")))
    named = found.where(F.col("found").isNotNull()).select(*carried, "found", _column_names(naming).alias("names"))
    return named.withColumn("again", _again("names"))


def _with_cells(rows: DataFrame, carried: Sequence[str]) -> DataFrame:
    # A repeated column name keeps its last cell: the one whose name comes again beyond the row only.
    rows = rows.withColumn("listed", F.from_json("text", "array<string>"))
    pairs = F.transform("listed", lambda v, i: F.struct(
        F.coalesce(F.get("names", i), F.concat(F.lit("col_"), i.cast("string"))).alias("key"), v.alias("value")))
    last = F.filter(pairs, lambda p, i: F.coalesce(F.get("again", i), F.lit(_NEVER)) >= F.size("listed"))
    cells = (
        F.when(F.col("text").startswith("["), F.map_from_entries(last))
        .when(F.col("text").startswith("{"), F.from_json("text", "map<string,string>"))
        .otherwise(F.create_map(F.lit("value"), F.col("text")))
    )
    return rows.select(*carried, "row", cells.alias("cells"))


def read_prediction_json(
    spark: SparkSession, path: str, naming: str = "display", missing: str = "error", whole_up_to: int = WHOLE_BYTES
) -> DataFrame:
    """Result documents below ``path``, one JSON document per file.

    Files of up to ``whole_up_to`` bytes are parsed as one text each. In longer ones all tasks cut rows from the split
    they read, so no task holds such a document.
    """
    short = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= whole_up_to).select(
        F.col("_metadata.file_path").alias("file"), "value")
    parsed = parse_prediction_json(short, naming=naming, missing=missing)
    cut = cut_long_documents(spark, path, whole_up_to)
    if cut is None:
        return parsed
    rests, rows = cut
    # Stored, so that the planner knows its size: it has one row per long file.
    named = pin(_named_tables(rests, "value", naming, missing).select("file", "names", "again", "found.table_data"))
    number = F.regexp_extract(F.get("table_data", 0), r'^\{"cut":(\d+)\}$', 1).try_cast("long")
    tables = named.select("file", "names", "again", F.when(F.size("table_data") == 1, number).alias("table"), "table_data")
    # A list or object keeps its text, as in a list that is parsed whole; others are unquoted.
    text = F.when(F.ltrim("text").rlike(r"\A\s*[\[{]"), F.regexp_replace("text", r"\A\s+|\s+\z", "")).otherwise(
        F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), 0))
    found = lookup_join(rows, tables.where("table IS NOT NULL").drop("table_data"), ["file", "table"], "inner").select(
        "file", "names", "again", F.col("row").cast("int").alias("row"), text.alias("text"))
    # Tables whose key isn't spelled plainly are still in the rest.
    uncut = tables.where("table IS NULL").select("file", "names", "again", F.posexplode("table_data").alias("row", "text"))
    return parsed.unionByName(_with_cells(found.unionByName(uncut), ["file"]))
