"""Gap-free numbers over a total order without moving the table through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from epitrove.plans.joins import lookup_join
from epitrove.plans.storage import pin

_PART, _INDEX, _OFFSET, _FIRST = "__part", "__index", "__offset", "__first"
_ROW_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Number all rows 1, 2, 3, … in the order of ``order`` (a unique key).

    Rows are range-partitioned and sorted, numbered inside each partition, and shifted by the
    sizes of the partitions before. The partitions are pinned first: a partition that is computed
    again must keep its bounds.
    """
    placed = (
        df.repartitionByRange(*[F.col(f"`{c}`") for c in order])
        .sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_INDEX, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    placed = pin(placed)
    # One row per partition.
    sizes = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("size").over(before), F.lit(0)).alias(_OFFSET))
    return (
        lookup_join(placed, offsets, _PART, "inner")
        .withColumn(name, F.col(_INDEX) + F.col(_OFFSET) + F.lit(1))
        .drop(_PART, _INDEX, _OFFSET)
    )


def number_rows_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """``row_number`` over ``keys`` that also works when one key owns most of the rows."""
    numbered = number_rows(df, [*keys, *order], name)
    firsts = numbered.groupBy(*keys).agg(F.min(name).alias(_FIRST))
    return (
        lookup_join(numbered, firsts, keys, "inner")
        .withColumn(name, F.col(name) - F.col(_FIRST) + F.lit(1))
        .drop(_FIRST)
    )
