"""Which documents a classifier may learn from, and bounded samples of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epitrove.plans.storage import pin

_BUCKETS = 1 << 30


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels may not be learned from; a null id has none and is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample_order(key: str) -> Column:
    """The place of a key in the order that samples are taken by."""
    return F.pmod(F.xxhash64(key), F.lit(_BUCKETS))


def below_share(key: str, most: int, count: Column) -> Column:
    """Holds for about one and a half times as many of ``count`` keys as ``most``, the first in that order.

    What is sorted or ranked afterwards has then the size of the sample, however many rows and tasks there are.
    """
    share = F.least(F.lit(1.0), (F.lit(1.5) * most + 1_000) / F.greatest(count, F.lit(1)))
    return sample_order(key) < F.ceil(share * _BUCKETS)


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` distinct rows whose keys come first in the order of their hashes."""
    count = F.lit(rows.count())
    return rows.where(below_share(key, most, count)).distinct().orderBy(sample_order(key), key).limit(most)


def one_text_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, text) stored, with the smallest text only where keys repeat. There must be a bounded number of keys.

    Where none repeat, no text is sorted or shuffled.
    """
    rows = pin(rows.select(*keys, "text"))
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return rows
    once = rows.join(F.broadcast(again), keys, "left_anti")
    least = rows.join(F.broadcast(again), keys, "left_semi").groupBy(*keys).agg(F.min("text").alias("text"))
    return pin(once.unionByName(least))
