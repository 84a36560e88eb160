"""Shards of near equal bytes that are ranges of one order, from global prefix sums of sizes.

The order is that of the text's MD5 and then doc_id, so copies of a text lie together, and a shard
is a mix of all sources and ages. A document's shard is the equal target in which its middle byte
lies. Sizes differ from the target by no more than a document at either end. A group of copies is
split only where a cut falls into it: the law is on bytes, and a group may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epitrove.llm.ordering import running


def shards(docs: DataFrame, count: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` for each row of ``docs``.

    ``size`` is the UTF-8 length of the text and one; a null text has none. ``slot`` is the place in
    the shard, without gaps from 0. ``grown_shard`` is null: under the law ``bytes`` another count
    of shards cuts anew. A null id sorts first; rows that repeat an id are placed one after the other. Other columns of
    ``docs``, whatever their names, are left out; an empty table has no rows, and a long text is measured, never moved.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("mark"),
    )
    placed = running(rows, ["mark", "doc_id"], {"start": F.col("size"), "number": F.lit(1).cast("long")})
    total = placed.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 1
    # The middle, in half bytes, against equal parts of the total in half bytes.
    shard = F.expr(f"cast(((2 * start + size) * {count}L) div {2 * total}L as int)")
    placed = placed.withColumn("shard", shard)
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first"))
    # At most ``count`` rows.
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

