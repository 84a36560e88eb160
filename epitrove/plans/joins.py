"""Look-up joins.

They are ordinary equi-joins: the optimizer broadcasts a side by its bytes, at run time too, and
the adaptive skew join splits a key that owns a large share of the rows. Planning one starts no job.
A look-up is broadcast by name only where the caller can prove a bound on its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 50_000


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str] | str, how: str = "left", at_most: int | None = None) -> DataFrame:
    """Join a look-up to ``rows``; ``how`` is inner, left, left_semi or left_anti.

    ``at_most`` is a bound of the look-up's rows that the caller can prove.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a look-up cannot be joined by {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if at_most is not None and at_most <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    return rows.join(lookup, keys, how)


def literal_list(values: Iterable, element: str = "string") -> Column:
    """A Python list as an array Column, to be exploded in place of a join with a tiny table."""
    items = [F.lit(value).cast(element) for value in values]
    return F.array(*items) if items else F.array().cast(f"array<{element}>")


def inline_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A few rows of Python values as a relation whose small size the planner knows.

    It does not know that of a DataFrame made from a list, and would sort the other side of a join by the key.
    """
    fields = [field.rsplit(" ", 1) for field in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(fields, row, strict=True)]) for row in rows]
    kind = f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in fields)}>>"
    return spark.range(1).select(F.inline((F.array(*structs) if structs else F.array()).cast(kind)))
