"""Prefix sums and row numbers over a total order, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from epitrove.plans.storage import pin

_ROW_BITS = 33


def running(rows: DataFrame, order: list[str], sizes: dict[str, Column], within: str | None = None) -> DataFrame:
    """``rows`` and, for each name in ``sizes``, the sum of that size over all rows before in ``order``.

    With ``within`` the sums start anew for each of its values, and rows are ordered by it first.
    ``order`` should leave no ties but between equal rows. Rows are range-partitioned and sorted.
    Each partition is summed by itself and shifted by the totals of the partitions before: one row
    per partition (and value of ``within`` in it) goes through one task.
    The sorted rows are written to the shared folder, so a partition that is read again is the same.
    """
    keys = ([within] if within else []) + order
    placed = rows.select("*", *[size.alias(f"__{name}") for name, size in sizes.items()]).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Both numbers are taken from one sorted partition: its place in the order, and the row's place in it.
    placed = pin(placed.select("*", F.spark_partition_id().alias("__part"),
                               F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("__row")))
    group = ["__part"] + ([within] if within else [])
    inside = Window.partitionBy(*group).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sizes])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    if within:
        before = Window.partitionBy(within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*[F.col(g).alias(f"__of_{g}") for g in group], *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__shift_{n}") for n in sizes])
    summed = placed.select("*", *[F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)).alias(f"__inside_{n}") for n in sizes])
    match = [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in group]
    # One row per partition of the rows, or per partition and value at its edges.
    joined = summed.join(F.broadcast(shifts) if not within else shifts, match)
    return joined.select(*rows.columns, *[(F.col(f"__inside_{n}") + F.col(f"__shift_{n}")).alias(n) for n in sizes])
