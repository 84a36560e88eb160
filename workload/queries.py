"""One Spark query per operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from epitrove.functions import schema
from epitrove.functions.text import percentile_band, residue_group
from epitrove.operators import (
    alignment, filters as flt, frequencies as frq, peptides as pep, predictions as prd, summaries as smy,
    tallies as tly, values as val,
)
from epitrove.operators.filters import IsolateFilter
from epitrove.plans.joins import literal_list
from epitrove.plans.storage import scratch_path
from epitrove.sources import fasta, pair_store, peptide_lists, results, sinks, tables
from workload import adapters as ad

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SELECTED = "MKTAYIAKQ"
PICKED = ad.ALLELES[:2]
UPLOAD_COLUMNS = ["peptide", "protein", "attribute_1", "attribute_2", "attribute_3"]
METHOD = "netmhcpan_el"
FREQUENT_SHARE, FREQUENT_LEAST = 0.002, 6
SEQUENCES_PER_REQUEST = 500


def query(function: Query) -> Query:
    """Register under the function's name; an outer ``_`` only keeps it apart from an import."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


# Sources


@query
def scan_sequences(spark, sf):
    path = scratch_path(spark, "isolates")
    sinks.partition_by_protein(ad.isolates(spark, sf), path)
    return tables.scan_sequences(spark, path, "M1", "A").select("seq_id", "protein", "genotype", "host", "sequence")


@query
def scan_position_frequencies(spark, sf):
    path = scratch_path(spark, "frequencies")
    frq.build_position_table(ad.isolates(spark, sf), path)
    return tables.scan_position_frequencies(spark, path, "HA")


@query
def load_profile(spark, sf):
    profile = frq.load_profile(ad.stored_frequencies(spark, sf))
    return profile.select("protein", "position", F.explode_outer("shares").alias("aminoacid", "value"))


@query
def read_allele_list(spark, sf):
    return tables.read_allele_list(ad.allele_table(spark, sf), ["Class I", "class_i", "classi"])


@query
def read_fasta(spark, sf):
    path = scratch_path(spark, "fasta")
    sinks.export_fasta(ad.scanned_sequences(spark, sf), path, "seq_id", "sequence", width=25)
    return fasta.read_fasta(spark, path).select("protein", "raw_sequence")


@query
def read_fasta_strict(spark, sf):
    path = scratch_path(spark, "fasta")
    spoilt = ad.scanned_sequences(spark, sf).select(
        F.concat("seq_id", F.lit(" scanned|"), "protein").alias("header"),
        F.expr(
            "CASE WHEN seq_index % 7 = 0 THEN concat(lower(sequence), 'XBX')"
            " WHEN seq_index % 11 = 0 THEN '--*' ELSE concat(sequence, '-*') END"
        ).alias("body"),
    )
    sinks.export_fasta(spoilt, path, "header", "body")
    # Three files in which most names repeat and many are literally the suffixed form of another.
    clashing = scratch_path(spark, "fasta")
    named = ad.scanned_sequences(spark, sf).select(
        (F.col("seq_index") % 3).alias("part"), "seq_index", "sequence",
        F.expr("CASE seq_index % 5 WHEN 2 THEN concat('hot_', seq_index % 23) WHEN 3 THEN concat('hot_2_', seq_index % 7)"
               " WHEN 4 THEN seq_id ELSE 'hot' END").alias("header"),
    )
    named.repartition("part").sortWithinPartitions("part", "seq_index").select(
        "part", F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("record")).write.partitionBy("part").text(clashing)
    valid, issues = fasta.read_fasta_strict(spark, path)
    settled, _ = fasta.read_fasta_strict(spark, clashing)
    absent = F.lit(None).cast("string")
    return valid.unionByName(settled).select("id", "sequence", absent.alias("type"), absent.alias("chars")).unionByName(
        issues.select("id", absent.alias("sequence"), "type", "chars")
    )


@query
def read_peptides_csv(spark, sf):
    path = scratch_path(spark, "peptides")
    named = ad.uploads(spark, sf).select(
        F.lower("peptide").alias("Peptide"), F.concat(F.lit(" "), "protein").alias("Protein"),
        F.concat("attribute_1", F.lit(', "x"')).alias("Attribute 1"), F.col("attribute_2").alias("Attribute 2"),
    )
    named.write.csv(path, header=True, quote='"', escape='"')
    return tables.read_peptides_csv(spark, path)


@query
def read_peptides_csv_simple(spark, sf):
    path = scratch_path(spark, "peptides")
    ad.uploads(spark, sf).select(
        F.col("attribute_1").alias("Note"), F.lower("peptide").alias("Peptide"), F.col("protein").alias("Protein")
    ).write.csv(path, header=True)
    return tables.read_peptides_csv_simple(spark, path)


@query
def read_peptide_list(spark, sf):
    path = scratch_path(spark, "peptides")
    ad.uploads(spark, sf).select(
        F.expr("concat(lower(peptide), CASE WHEN peptide_id % 9 = 0 THEN 'x' ELSE '-' END, ';', attribute_1)")
    ).write.text(path)
    return peptide_lists.read_peptide_list(spark, path).select("peptide")


@query
def read_predictions_csv(spark, sf):
    path = scratch_path(spark, "predictions")
    ad.predictions(spark, sf).select(
        F.lit(" M1 ").alias("protein"), "allele", F.lower("peptide").alias("peptide"),
        F.lower("peptide").alias("root"), (F.col("netmhcpan_ba_percentile") / 100).alias("proportion_all"),
        "netmhcpan_el_percentile",
    ).write.csv(path, header=True, quote='"', escape='"')
    return tables.read_predictions_csv(spark, path)


@query
def read_predictions_csv_wide(spark, sf):
    path = scratch_path(spark, "predictions")
    ad.predictions(spark, sf).select(
        F.lit("core").alias("core"), "peptide", F.lit(1).alias("icore"), "allele",
        "netmhcpan_ba_percentile", "netmhcpan_el_percentile",
    ).write.csv(path, header=True)
    return tables.read_predictions_csv_wide(spark, path)


@query
def parse_prediction_json(spark, sf):
    cells = F.array("allele", "peptide", F.col("start").cast("string"), F.col("netmhcpan_ba percentile").cast("string"))
    column_names = ["allele", "peptide", "start", "netmhcpan_ba percentile"]
    columns = F.array(*[F.struct(F.lit(n.split()[0]).alias("name"), F.lit(n).alias("display_name")) for n in column_names])
    # One document per scanned sequence, as the service answers them.
    documents = ad.scan_predictions(spark, sf).groupBy("seq #").agg(F.collect_list(cells).alias("rows")).select(
        F.to_json(F.struct(F.struct(F.array(
            F.struct(F.lit("warnings").alias("type"), F.lit(None).alias("table_columns"), F.lit(None).alias("table_data")),
            F.struct(F.lit("peptide_table").alias("type"), columns.alias("table_columns"), F.col("rows").alias("table_data")),
        ).alias("results")).alias("data"))).alias("value")
    )
    parsed = results.parse_prediction_json(documents)
    return parsed.select(
        F.col("cells.allele").alias("allele"), F.col("cells.peptide").alias("peptide"),
        F.col("cells.start").cast("int").alias("start"),
        F.col("cells")["netmhcpan_ba percentile"].cast("double").alias("ba"),
    )


@query
def read_prediction_json(spark, sf):
    """One file per allele, length and batch of sequences, in which two columns share a name or a display name, and one without the table."""
    path = scratch_path(spark, "results")
    listed = lambda *pairs: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).cast("string").alias("display_name")) for n, d in pairs])
    columns = listed(("allele", "Allele"), ("peptide", ""), ("start", None), ("peptide", "start"))
    cells = F.array("allele", "peptide", F.col("start").cast("string"), (F.col("netmhcpan_ba percentile") * 10).cast("int").cast("string"))
    batch = F.floor(F.coalesce("seq #", F.lit(1)) / SEQUENCES_PER_REQUEST).alias("batch")
    rows = ad.scan_predictions(spark, sf).groupBy("allele", F.col("peptide length").alias("length"), batch).agg(F.collect_list(cells).alias("rows"))
    table = F.struct(F.lit("peptide_table").alias("type"), columns.alias("table_columns"), F.col("rows").alias("table_data"))
    other = F.struct(F.lit("warnings").alias("type"), F.lit(None).alias("table_columns"), F.lit(None).alias("table_data"))
    document = lambda *found: F.to_json(F.struct(F.struct(F.array(*found).alias("results")).alias("data"))).alias("value")
    part = F.concat_ws("-", F.regexp_replace("allele", "[^A-Z0-9]", ""), "length", "batch").alias("part")
    rows.select(part, document(other, table)).unionByName(rows.select(F.lit("none").alias("part"), document(other)).distinct()).repartition(
        "part").write.partitionBy("part").text(path)
    read = lambda naming: results.read_prediction_json(spark, path, naming, "empty")
    allele = F.coalesce(F.col("cells")["allele"], F.col("cells")["Allele"]).alias("allele")
    shown = lambda naming: read(naming).select(F.lit(naming).alias("naming"), allele, F.col("cells.peptide").alias("peptide"), F.col("cells.start").alias("start"))
    return shown("name").unionByName(shown("filled"))


@query
def inline_windows(spark, sf):
    windows = tables.inline_windows(spark, ad.WINDOWS).select("*", F.explode(literal_list(ad.BASES)).alias("protein"))
    cut = tly.cross_windows(ad.isolates(spark, sf), windows, ["protein"], ["protein"])
    return cut.groupBy("protein", "start", "len").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("peptide").alias("peptides")
    )


# Sinks


def _unrounded(spark, sf):
    return ad.predictions(spark, sf).withColumns({
        "netmhcpan_el_percentile": F.col("netmhcpan_el_percentile") / 7,
        "netmhcpan_ba_percentile": F.col("netmhcpan_ba_percentile") / 20 + 0.005,
    })


@query
def slim_predictions(spark, sf):
    path = scratch_path(spark, "slim")
    sinks.write_slim(sinks.slim_predictions(_unrounded(spark, sf)), path)
    return spark.read.parquet(path)


@query
def slim_peptide_table(spark, sf):
    path = scratch_path(spark, "slim")
    wide = ad.scan_predictions(spark, sf).withColumn("netmhcpan_el percentile", F.col("netmhcpan_el percentile") / 7)
    sinks.write_slim(sinks.slim_peptide_table(wide), path)
    return spark.read.parquet(path)


@query
def partition_by_protein(spark, sf):
    path = scratch_path(spark, "isolates")
    sinks.partition_by_protein(ad.isolates(spark, sf), path, only=["M1", " NP "])
    return spark.read.parquet(path).select("seq_id", "protein", "genotype", "host", "country", "sequence")


@query
def append_predictions(spark, sf):
    path = scratch_path(spark, "results")
    rows = ad.predictions(spark, sf)
    sinks.append_predictions(rows.where("netmhcpan_ba_percentile <= 50"), path)
    sinks.append_predictions(rows.where("netmhcpan_ba_percentile > 50"), path)
    return tables.read_predictions_csv_wide(spark, path)


def _csv_rows(spark, sf):
    return ad.uploads(spark, sf).select(
        "peptide_id", F.concat("attribute_1", F.lit(', "new"\nline')).alias("note"), "peptide", "attribute_3"
    )


@query
def export_csv_quoted(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.export_csv_quoted(_csv_rows(spark, sf), path)
    return spark.read.text(path).where("value NOT LIKE '\"peptide_id\"%'").select(F.col("value").alias("line"))


@query
def export_csv_minimal(spark, sf):
    path = scratch_path(spark, "csv")
    rows = ad.uploads(spark, sf)
    first = rows.select("peptide_id", F.concat("attribute_1", F.lit(', "new"')).alias("note"))
    second = rows.select("peptide_id", "peptide")
    sinks.export_csv_minimal([first, second], path)
    return spark.read.text(path).where("value <> 'peptide_id,note,peptide'").select(F.col("value").alias("line"))


@query
def export_fasta(spark, sf):
    rows = ad.scanned_sequences(spark, sf).select(
        "seq_index", F.expr("CASE WHEN seq_index % 3 > 0 THEN seq_id END").alias("name"),
        F.concat("sequence", F.lit(" "), "sequence").alias("sequence"),
    )
    return sinks.fasta_records(rows, "name", "sequence", order=["seq_index"])


# Filters


@query
def filter_in(spark, sf):
    wanted = IsolateFilter(genotypes=("H1N1", "H2N2"), hosts=("Homo sapiens", "Gallus gallus"))
    return flt.filter_isolates(ad.isolates(spark, sf), wanted).select("seq_id", "genotype", "host")


@query
def filter_in_trimmed(spark, sf):
    wanted = IsolateFilter(hosts=("Homo sapiens", "Gallus gallus"), trimmed=True)
    return flt.filter_isolates(ad.isolates(spark, sf), wanted).select("seq_id", "genotype", "host")


@query
def filter_host_category(spark, sf):
    rows = ad.isolates(spark, sf)
    parts = [
        flt.filter_isolates(rows, IsolateFilter(host_categories=chosen)).select(F.lit(label).alias("choice"), "seq_id", "host")
        for label, chosen in {"human": ("Human",), "other": ("Non-human",), "both": ("Human", "Non-human")}.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def filter_partial_date(spark, sf):
    rows = ad.isolates(spark, sf)
    limits = {"range": ("1995-01-01", "1997-06-30"), "from": ("1998-02-01", None), "to": (None, "1994-12-31")}
    parts = [
        flt.filter_isolates(rows, IsolateFilter(collected=limit)).select(F.lit(label).alias("choice"), "seq_id", "collection_date")
        for label, limit in limits.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def filter_isolates(spark, sf):
    wanted = IsolateFilter(
        protein="NP", genotypes=("H1N1", "H2N2", "H3N3", "H4N1"), host_categories=("Non-human",),
        countries=("NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5"),
        collected=("1993-01-01", None), released=("1993-01-01", "2000-12-31"),
    )
    return flt.filter_isolates(ad.isolates(spark, sf), wanted).select(
        "seq_id", "genotype", "host", "country", "collection_date", "release_date", "sequence"
    )


@query
def filter_nonblank(spark, sf):
    return flt.filter_nonblank(ad.allele_table(spark, sf), "Class I").select(F.col("Class I").alias("allele"))


@query
def search_values(spark, sf):
    rows = ad.isolates(spark, sf).withColumn("host", F.expr("if(seq_id % 3 = 0, concat('a\\\\b ', host), host)"))
    found = [flt.search_values(rows, "host", text).select(F.lit(text).alias("text"), "seq_id", "host") for text in ("galL%S", "A\\b%o", "h\\")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def filter_peptide_length(spark, sf):
    gapped = ad.uploads(spark, sf).select(
        "peptide_id", F.expr("CASE WHEN peptide_id % 2 = 0 THEN concat(substr(peptide, 1, 3), '--', substr(peptide, 4))"
                             " ELSE peptide END").alias("peptide")
    )
    out = None
    for mhc_class in ("I", "II"):
        kept, excluded = flt.filter_peptide_length(gapped, mhc_class)
        for label, part in (("kept", kept), ("excluded", excluded)):
            part = part.select(F.lit(mhc_class).alias("mhc_class"), F.lit(label).alias("part"), "peptide_id", "peptide")
            out = part if out is None else out.unionByName(part)
    return out


@query
def filter_alphabet(spark, sf):
    return flt.filter_alphabet(ad.isolates(spark, sf), "sequence").select("seq_id", "sequence")


@query
def filter_root_rows(spark, sf):
    return flt.filter_root_rows(ad.annotated(spark, sf)).select("allele", "peptide", "root")


@query
def filter_frequency(spark, sf):
    return flt.filter_frequency(ad.stored_frequencies(spark, sf), 8, {"HA"}).select(
        "protein", "position", "aminoacid", "frequency_all"
    )


@query
def select_metric(spark, sf):
    return flt.select_metric(ad.live_frequencies(spark, sf), True, ["value", "frequency", "total"], ["position", "aminoacid"])


@query
def select_facet(spark, sf):
    wanted = IsolateFilter(hosts=("Homo sapiens", "AUTOMOBILE"))
    facet = flt.facet_choices(wanted)[0]
    chosen = flt.select_facet(flt.filter_isolates(ad.isolates(spark, sf), wanted), facet)
    return chosen.groupBy("facet").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence").alias("sequences"))


@query
def resolve_percentile_column(spark, sf):
    rows = ad.scan_predictions(spark, sf).withColumnRenamed("netmhcpan_el percentile", "NetMHCpan_EL Percentile rank")
    loose = schema.percentile_column(rows.columns, METHOD)
    exact = schema.percentile_column(rows.columns, "netmhcpan_ba")
    by_class = schema.class_percentile_column(rows.columns, "I", "BA")
    both = ad.of_both_classes(ad.scan_predictions(spark, sf))
    by_row = both.select(
        "allele", "peptide", "start", *[F.lit(None).cast("double").alias(c) for c in ("el", "ba", "ba_by_class")],
        schema.percentile_value(both.columns, "EL").alias("el_by_row"), schema.percentile_value(both.columns, "BA").alias("ba_by_row"),
        schema.percentile_value(both.columns, "BA", explicit="netmhciipan_ba percentile").alias("ba_explicit"),
    )
    return rows.select("allele", "peptide", "start", *[
        schema.quoted(c).alias(n) for n, c in (("el", loose), ("ba", exact), ("ba_by_class", by_class))
    ], *[F.lit(None).cast("double").alias(c) for c in ("el_by_row", "ba_by_row", "ba_explicit")]).unionByName(by_row)


@query
def resolve_length_column(spark, sf):
    rows = ad.scan_predictions(spark, sf)
    other = rows.withColumnRenamed("peptide length", "Length").drop("seq #")
    pick = lambda d: d.select(
        schema.sequence_number(d).alias("seq_no"), schema.peptide_length(d).alias("length"), "allele", "peptide"
    )
    return pick(rows).unionByName(pick(other))


@query
def normalize_predictions(spark, sf):
    rows = ad.scan_predictions(spark, sf).withColumns({"allele": F.lower("allele"), "peptide": F.lower("peptide")})
    return flt.normalize_predictions(rows)


@query
def filter_predictions_slice(spark, sf):
    return flt.filter_predictions_slice(ad.scan_predictions(spark, sf), 1, 9, ad.ALLELES[1]).select(
        "allele", "peptide", "start", F.col("netmhcpan_ba percentile").alias("ba")
    )


@query
def filter_aligned_for_sequence(spark, sf):
    return flt.filter_aligned_for_sequence(_occurrences(spark, sf), 2, 9)


@query
def classify_aligned(spark, sf):
    rows = ad.aligned(spark, sf).withColumn(
        "status", F.expr("CASE peptide_id % 4 WHEN 0 THEN 'Misaligned' WHEN 1 THEN 'ALIGNED ok' WHEN 2 THEN 'new' END")
    )
    return flt.classify_aligned(rows).select("peptide_id", "status", "is_aligned")


@query
def percentile_band_(spark, sf):
    rows = ad.scan_predictions(spark, sf).select(percentile_band(F.col("netmhcpan_el percentile")).alias("band"), "allele")
    return rows.groupBy("allele", "band").agg(F.count(F.lit(1)).alias("n"))


@query
def residue_group_(spark, sf):
    cells = frq.explode_positions(ad.isolates(spark, sf), ["protein"])
    return cells.groupBy("protein", residue_group(F.col("aminoacid")).alias("residue_group")).agg(F.count(F.lit(1)).alias("n"))


@query
def attribute_categories(spark, sf):
    return flt.attribute_categories(ad.uploads(spark, sf), "attribute_2")


# Joins and lateral operators


@query
def explode_positions(spark, sf):
    cells = frq.explode_positions(ad.isolates(spark, sf), ["seq_id"])
    return cells.groupBy("position", "aminoacid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq_id").alias("id_sum")
    )


@query
def cross_windows(spark, sf):
    return tly.cross_windows(ad.isolates(spark, sf), ad.WINDOWS, ["seq_id"])


@query
def full_outer_all_unique(spark, sf):
    rows = ad.isolates(spark, sf)
    by = ["protein"]
    keys = [*by, "start", "len", "peptide"]
    every = tly.cross_windows(rows, ad.WINDOWS, by).groupBy(keys).agg(F.count(F.lit(1)).alias("frequency_all"))
    once = tly.cross_windows(frq.distinct_sequences(rows, by), ad.WINDOWS, by).groupBy(keys).agg(
        F.count(F.lit(1)).alias("frequency_unique")
    )
    return tly.full_outer_all_unique(every, once, by)


@query
def left_join_totals(spark, sf):
    counts = frq.explode_positions(ad.isolates(spark, sf), ["protein"]).groupBy("protein", "position", "aminoacid").agg(
        F.count(F.lit(1)).alias("frequency_all"), F.count(F.lit(1)).alias("frequency_unique")
    )
    return frq.left_join_totals(counts, ["protein", "position"]).drop("frequency_unique", "total_unique", "value_unique")


@query
def join_top_facets(spark, sf):
    weighted = frq.distinct_sequences(flt.select_facet(ad.isolates(spark, sf), "country"), ["facet"])
    return frq.join_top_facets(weighted, frq.top_facets(weighted, unique=True))


def _half_cached(spark, sf):
    return ad.predictions(spark, sf).where("netmhcpan_el_percentile < 3")


@query
def missing_predictions(spark, sf):
    work = ad.uploads(spark, sf).select("peptide").where("length(peptide) between 8 and 14")
    return prd.missing_predictions(work, ad.ALLELES, _half_cached(spark, sf))


@query
def missing_request(spark, sf):
    work = ad.uploads(spark, sf).select("peptide").where("length(peptide) between 8 and 14")
    alleles, peptides = prd.request_of_missing(prd.missing_predictions(work, ad.ALLELES, _half_cached(spark, sf)))
    return alleles.select(F.lit("allele").alias("kind"), F.col("allele").alias("name")).unionByName(
        peptides.select(F.lit("peptide").alias("kind"), F.col("peptide").alias("name"))
    )


@query
def merge_predictions(spark, sf):
    rows = ad.scan_predictions(spark, sf).select(
        "allele", "peptide", "seq #", "start", F.col("netmhcpan_el percentile").alias("el"), F.col("netmhcpan_ba percentile").alias("ba")
    ).withColumn("seq #", F.coalesce("seq #", F.lit(1)))
    cached, fresh = rows.where("ba < 60"), rows.where("ba >= 60")
    return prd.merge_predictions(cached, fresh, ["seq #", "start"]).select("allele", "peptide", "el", "ba")


@query
def merge_stored_predictions(spark, sf):
    """As ``merge_predictions``, into a cache stored by pair, in two steps."""
    rows = ad.scan_predictions(spark, sf).select(
        "allele", "peptide", F.coalesce("seq #", F.lit(1)).alias("seq_no"), "start",
        F.col("netmhcpan_el percentile").alias("el"), F.col("netmhcpan_ba percentile").alias("ba"))
    table, order = f"predictions_{uuid.uuid4().hex}", ["seq_no", "start"]
    pair_store.create_store(rows.where("ba < 60"), table, scratch_path(spark, "predictions"), order, slots=4)
    pair_store.merge_into_store(spark, table, rows.where("ba >= 60 and start = 7 and seq_no < 3"), order)
    return pair_store.merge_into_store(spark, table, rows.where("ba >= 60"), order).select("allele", "peptide", "el", "ba")


@query
def restrict_predictions(spark, sf):
    return prd.restrict_predictions(ad.predictions(spark, sf), ad.uploads(spark, sf), PICKED)


@query
def predictions_for_peptides(spark, sf):
    listed = ad.uploads(spark, sf).select(F.concat(F.lit(" "), F.lower("peptide"), F.lit("- ")).alias("peptide"))
    return prd.predictions_for_peptides(ad.scan_predictions(spark, sf), listed).select(
        F.coalesce("seq #", F.lit(1)).alias("seq_no"), "allele", "peptide", "start"
    )


def _repeated_predictions(spark, sf):
    """Predictions of both classes in which an (allele, peptide) pair comes once per sequence and place."""
    return ad.of_both_classes(ad.scan_predictions(spark, sf)).withColumn("seq_no", F.coalesce("seq #", F.lit(1)))


@query
def overlay_percentiles(spark, sf):
    rows = ad.uploads(spark, sf).select("peptide_id", "peptide")
    return prd.overlay_percentiles(rows, PICKED, _repeated_predictions(spark, sf), ["seq_no", "start"])


@query
def percentile_by_allele_key(spark, sf):
    rows = ad.aligned(spark, sf).select(
        "peptide_id", F.expr("CASE WHEN peptide_id % 2 = 0 THEN peptide ELSE 'Q' END").alias("peptide"), "peptide_aligned"
    )
    return prd.percentile_by_allele_key(rows, "a0201", _repeated_predictions(spark, sf), "EL", ["seq_no", "start"]).select("peptide_id", "percentile")


@query
def allele_matrix(spark, sf):
    return prd.allele_matrix(ad.predictions(spark, sf), ad.ALLELES[:3], "netmhcpan_ba_percentile")


@query
def align_peptides(spark, sf):
    return ad.aligned(spark, sf).select(
        "peptide_id", "protein", "peptide", "length_raw", "length", "start_raw", "start", "peptide_aligned", "aligned_length"
    )


def _occurrences(spark, sf):
    wanted = ad.uploads(spark, sf).select("peptide").distinct()
    return pep.find_occurrences(ad.scanned_sequences(spark, sf), wanted)


@query
def find_occurrences(spark, sf):
    return _occurrences(spark, sf)


@query
def compare_reference_consensus(spark, sf):
    agreed = frq.consensus(ad.stored_frequencies(spark, sf), by=["protein"])
    return frq.compare_reference_consensus(ad.references(spark), agreed, ["protein"])


@query
def mismatch_template(spark, sf):
    rows = tly.window_tallies(ad.isolates(spark, sf).where("protein = 'M1'"), [(1, 9)])
    alternates = tly.top_alternates(rows, "MKTA--YIAKQ")
    return tly.mismatch_template(alternates, "MKTA--YIAKQ").select("ungapped_key", "display_peptide", "mismatches")


@query
def peptide_proportion_lookup(spark, sf):
    placed, tallies = ad.uploads_and_tallies(spark, sf)
    return tly.peptide_proportion_lookup(placed, tallies).select("peptide_id", "proportion")


@query
def window_roots(spark, sf):
    placed, _, candidates = ad.uploads_and_candidates(spark, sf)
    return tly.window_roots(placed, candidates)


@query
def annotate_predictions(spark, sf):
    placed, tallies, candidates = ad.uploads_and_candidates(spark, sf)
    return tly.annotate_predictions(ad.predictions(spark, sf), tallies, tly.window_roots(placed, candidates))


@query
def label_sequences(spark, sf):
    names = ad.scanned_sequences(spark, sf).where("seq_index % 4 > 0").select(
        F.col("seq_index").alias("seq_no"), F.col("seq_id").alias("id")
    )
    return prd.label_sequences(ad.scan_predictions(spark, sf), names).select("label", "allele", "peptide", "start")


@query
def qualifying_root_join(spark, sf):
    return smy.qualifying_root_join(ad.annotated(spark, sf), 20).select("allele", "peptide", "one_root", "root")


# Aggregations


@query
def position_frequencies(spark, sf):
    return ad.live_frequencies(spark, sf)


@query
def position_frequencies_fast(spark, sf):
    path = scratch_path(spark, "frequencies")
    rows = ad.isolates(spark, sf)
    frq.build_position_table(rows, path)
    return frq.position_frequencies_fast(rows, spark.read.parquet(path), IsolateFilter(protein="NP"))


@query
def build_position_table(spark, sf):
    path = scratch_path(spark, "frequencies")
    frq.build_position_table(ad.isolates(spark, sf), path)
    return spark.read.parquet(path)


@query
def window_tallies(spark, sf):
    return tly.window_tallies(flt.filter_isolates(ad.isolates(spark, sf), ad.NON_HUMAN), ad.WINDOWS)


@query
def window_tallies_selected(spark, sf):
    rows = tly.window_tallies(ad.isolates(spark, sf).where("protein = 'M1'"), [(1, 9)])
    return tly.window_tallies_selected(rows, "QQQQQQQQQ")


@query
def upload_window_tallies(spark, sf):
    return ad.upload_tallies(spark, sf)


@query
def peptide_tallies(spark, sf):
    placed, tallies = ad.uploads_and_tallies(spark, sf)
    return tly.peptide_tallies(placed, tallies)


@query
def distinct_values(spark, sf):
    return val.distinct_values(ad.isolates(spark, sf), "host")


@query
def consensus(spark, sf):
    return frq.consensus(ad.live_frequencies(spark, sf), "value_unique")


@query
def conservation_series(spark, sf):
    return frq.conservation_series(ad.live_frequencies(spark, sf))


@query
def facet_conservation(spark, sf):
    rows = flt.filter_isolates(ad.isolates(spark, sf), ad.NON_HUMAN)
    return frq.facet_conservation(rows, "country").drop("value_unique")


@query
def facet_conservation_unique(spark, sf):
    rows = flt.filter_isolates(ad.isolates(spark, sf), ad.NON_HUMAN)
    return frq.facet_conservation(rows, "genotype", unique=True).drop("value")


@query
def diversity_stack(spark, sf):
    stack = frq.diversity_stack(ad.stored_frequencies(spark, sf), by=["protein"])
    return stack.withColumns({c: F.round(c, 9) for c in ("y0", "y1")})


@query
def sequence_totals(spark, sf):
    return frq.sequence_totals(ad.live_frequencies(spark, sf))


@query
def metric_delta(spark, sf):
    before = IsolateFilter(protein="M1")
    return frq.metric_delta(ad.isolates(spark, sf), before, ad.NON_HUMAN)


@query
def aligned_summary(spark, sf):
    return tly.aligned_summary(ad.aligned(spark, sf))


@query
def conserved_summary(spark, sf):
    placed, tallies = ad.uploads_and_tallies(spark, sf)
    return tly.conserved_summary(placed, tallies)


@query
def frequency_summary(spark, sf):
    placed, tallies = ad.uploads_and_tallies(spark, sf)
    return tly.frequency_summary(placed, tallies)


@query
def min_percentile_by_position(spark, sf):
    return prd.min_percentile_by_position(ad.scan_predictions(spark, sf), METHOD)


@query
def position_extent(spark, sf):
    return prd.position_extent(ad.scan_predictions(spark, sf), METHOD)


@query
def min_percentile_by_peptide(spark, sf):
    rows = ad.scan_predictions(spark, sf)
    over_all = prd.min_percentile_by_peptide(rows, METHOD, 1, 9).withColumn("allele", F.lit("any"))
    of_one = prd.min_percentile_by_peptide(rows, METHOD, 2, 9, ad.ALLELES[2]).withColumn("allele", F.lit(ad.ALLELES[2]))
    return over_all.unionByName(of_one)


@query
def available_lengths(spark, sf):
    rows = ad.scan_predictions(spark, sf).where("`seq #` is null or `peptide length` < 8 + `seq #` % 4")
    return prd.available_lengths(rows, (9, 11))


@query
def binders_per_peptide(spark, sf):
    return smy.binders_per_peptide(ad.annotated(spark, sf), 20)


@query
def windows_score(spark, sf):
    return smy.windows_score(ad.annotated(spark, sf), 20).withColumn("score", F.round("score", 9))


@query
def proportion_histogram(spark, sf):
    rows = ad.scan_predictions(spark, sf).select("protein", (F.col("netmhcpan_ba percentile") / 100).alias("proportion_all"))
    return smy.proportion_histogram(rows)


@query
def protein_row_counts(spark, sf):
    return smy.protein_row_counts(ad.isolates(spark, sf))


@query
def max_overlap_depth(spark, sf):
    return pep.max_overlap_depth(ad.aligned(spark, sf), ["protein"])


@query
def generate_peptides(spark, sf):
    """The bound follows the number of isolates, as a fixed one would not suit every table size."""
    at_least = F.col("total_all") * FREQUENT_SHARE + FREQUENT_LEAST
    return pep.generate_peptides(ad.stored_frequencies(spark, sf), at_least, without={"HA"})


@query
def class_one_workset(spark, sf):
    candidates = ad.uploads_and_candidates(spark, sf)[2]
    return pep.class_one_workset(ad.uploads(spark, sf), candidates)


@query
def request_batches(spark, sf):
    return pep.request_batches(ad.predictions(spark, sf).select("peptide"))


@query
def request_batches_by_length(spark, sf):
    listed = ad.predictions(spark, sf).select("peptide").distinct().withColumn("peptide_len", F.length("peptide"))
    return pep.request_batches_by_length(listed)


# Ranking, sorting, paging, set operations


@query
def rank_facet_residue(spark, sf):
    rows = flt.filter_isolates(ad.isolates(spark, sf), ad.NON_HUMAN)
    return frq.rank_facet_residue(frq.facet_counts(rows, "country"))


@query
def top_candidates_by_window(spark, sf):
    return ad.uploads_and_candidates(spark, sf)[2]


@query
def top_alternates(spark, sf):
    rows = tly.window_tallies(ad.isolates(spark, sf).where("protein = 'M1'"), [(1, 9)])
    return tly.top_alternates(rows, SELECTED)


@query
def residue_ranking(spark, sf):
    return frq.residue_ranking(ad.stored_frequencies(spark, sf), by=["protein"])


@query
def page_values(spark, sf):
    rows = ad.isolates(spark, sf)
    first = val.page_values(rows, "country", offset=3).withColumn("page", F.lit("first"))
    found = val.page_values(rows, "country", "nation_1", offset=2).withColumn("page", F.lit("search"))
    return first.unionByName(found)


@query
def top_facets(spark, sf):
    return frq.top_facets(frq.distinct_sequences(flt.select_facet(ad.isolates(spark, sf), "host"), ["facet"]))


@query
def allele_options(spark, sf):
    rows = ad.allele_table(spark, sf)
    first = val.allele_options(rows, "I", offset=5).withColumn("page", F.lit("I"))
    found = val.allele_options(rows, "II", "drb1*1", offset=1).withColumn("page", F.lit("II"))
    return first.unionByName(found)


@query
def distinct_sequences(spark, sf):
    return frq.distinct_sequences(ad.isolates(spark, sf), ["protein"])


@query
def distinct_windows(spark, sf):
    return tly.distinct_windows(ad.aligned(spark, sf))


@query
def ordered_positions(spark, sf):
    return frq.ordered_positions(ad.live_frequencies(spark, sf)).select("position", "aminoacid", "frequency_all")


# Python workers


@query
def align_references(spark, sf):
    profile = frq.load_profile(ad.stored_frequencies(spark, sf))
    raw = ad.scanned_sequences(spark, sf).select(
        "seq_index", F.expr("concat(' ', lower(protein))").alias("protein"),
        F.expr("concat(substr(sequence, 1, 20 + seq_index % 9), substr(sequence, 24 + seq_index % 13))").alias("raw_sequence"),
    )
    return alignment.align_references(raw, profile).select("seq_index", "raw_sequence", "aligned_sequence")
