"""A table of predictions that is stored by (allele, peptide), for updates that move the fresh rows only.

Rows lie in slots, which are partitions, and in each slot in buckets, sorted; slot and bucket follow
from the pair. Merging joins the buckets of the slots that fresh rows fall into with these rows, and replaces
those slots. Stored rows are read where they lie and written back there: they are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epitrove.plans.storage import pin, scratch_path

PAIR = ["allele", "peptide"]
SLOTS = 32
"""Bounds the files: as many as slots times buckets."""


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64(*PAIR), F.lit(slots)).cast("int").alias("slot")


def latest_by_pair(rows: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per pair: the last by the columns ``order``, without it the one with the larger values.

    A maximum is taken within each task before the shuffle.
    """
    kept = [c for c in rows.columns if c not in PAIR]
    last = F.max_by(F.struct(*kept), F.struct(*(order or kept)))
    return rows.groupBy(*PAIR).agg(last.alias("last")).select(*PAIR, "last.*")


def _save(rows: DataFrame, table: str, buckets: int, path: str) -> None:
    rows.write.format("parquet").option("path", path).partitionBy("slot").bucketBy(buckets, *PAIR).sortBy(*PAIR).saveAsTable(table)


def create_store(rows: DataFrame, table: str, path: str, order: Sequence[str] = (), buckets: int | None = None, slots: int = SLOTS) -> DataFrame:
    """Store ``rows``, the last of each pair, as ``table`` at ``path``, a new folder; returns what is stored.

    Rows whose allele or peptide is null have no pair and are left out. By default there are as many buckets as a shuffle has partitions.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = latest_by_pair(rows.dropna(subset=PAIR), order).select("*", _slot(slots)).repartition(buckets, *PAIR)
    _save(placed, table, buckets, path)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('slots' = '{slots}', 'buckets' = '{buckets}')")
    return read_store(spark, table)


def read_store(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).drop("slot")


def _property(spark: SparkSession, table: str, name: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {table} ('{name}')").first()["value"])


def merged_slots(spark: SparkSession, table: str, fresh: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The rows of all slots that ``fresh`` touches, fresh ones in place of stored ones, with their ``slot``.

    The buckets of the stored rows are read as they are; only fresh rows are shuffled, to the same buckets.
    """
    slots = _property(spark, table, "slots")
    columns = [c for c in spark.table(table).columns if c not in (*PAIR, "slot")]
    new = latest_by_pair(fresh.dropna(subset=PAIR).select(*PAIR, *columns, *[c for c in order if c not in columns]), order).select(*PAIR, F.struct(*columns).alias("new"), _slot(slots).alias("new_slot"))
    # At most as many numbers as there are slots.
    touched = [r["slot"] for r in new.select(F.col("new_slot").alias("slot")).distinct().collect()]
    old = spark.table(table).where(F.col("slot").isin(touched)).select(*PAIR, F.struct(*columns).alias("old"), F.col("slot").alias("old_slot"))
    both = old.hint("merge").join(new, PAIR, "full")
    return both.select(*PAIR, F.coalesce("new", "old").alias("last"), F.coalesce("new_slot", "old_slot").alias("slot")).select(*PAIR, "last.*", "slot")


def merge_into_store(spark: SparkSession, table: str, fresh: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Put ``fresh`` rows into the store, later ones over earlier ones; returns what is stored then.

    New rows of a pair replace the stored one whatever its values; among fresh rows the last by ``order`` counts.
    The slots are staged with the same buckets first, as a table can't be read and replaced at once.
    """
    fresh = pin(fresh)
    buckets, staged, setting = _property(spark, table, "buckets"), f"{table}_staged", "spark.sql.sources.partitionOverwriteMode"
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    _save(merged_slots(spark, table, fresh, order), staged, buckets, scratch_path(spark, "staged"))
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        spark.table(staged).select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(setting, before)
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
    spark.catalog.refreshTable(table)
    return read_store(spark, table)
