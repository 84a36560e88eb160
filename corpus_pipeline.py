"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from epitrove.llm import minhash, mixing, packing, queries, substring_dedup
from epitrove.llm.folds import held_out
from epitrove.llm.toxicity import fit, scorer
from epitrove.plans.storage import scratch_path
from epitrove.session import ship_package

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below ``TOXIC_FROM``; learned from labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    return docs.where(scorer(model)(F.col("text").cast("string")) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return minhash.one_of_each(docs, size=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 13 words and more that an earlier one holds; others keep their text as it is."""
    cut = substring_dedup.cut_repeats(docs, window=13, verbatim=True)
    changed = F.col("n_removed") > 0
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"),
              "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the mix takes them."""
    return mixing.in_mix_order(docs, queries.SOURCE_WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens, packed in the order of the mix.

    Files don't come back in the order they were written in, so the places are worked out again.
    """
    placed = lambda pieces: mixing.with_places(pieces, docs, queries.SOURCE_WEIGHTS).withColumnRenamed("mix_place", "place")
    return packing.pack_by_place(docs, placed, queries.tokenizer_path(), most=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage's result is written to the shared folder."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
