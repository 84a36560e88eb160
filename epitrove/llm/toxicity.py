"""Toxicity scores by non-negative positive-unlabelled learning.

The positives are texts confirmed as toxic; all other training texts are unlabelled, and a share
``prior`` of them is taken to be toxic. A linear classifier over the hashed set of a text's words and word beginnings
is trained in numpy on the risk ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``
with the logistic loss. When the corrected negative part falls below zero the step goes the other way,
so the classifier can't profit from fitting the unlabelled texts by heart.

Training uses at most ``POSITIVES`` positive and ``UNLABELLED`` other texts, chosen by a hash of the id.
Their features are counted on the executors; only those that mark the positives reach the driver.
Scoring reads every text whole, on the executors, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epitrove.llm.folds import hash_sample, held_out, one_text_each
from epitrove.llm.words import NOT_LETTERS, Words, mix, slices
from epitrove.plans.storage import pin

POSITIVES, UNLABELLED = 4_000, 16_000
BUCKET_BITS = 20
PREFIXES = (4, 5, 6)
LEAST_TEXTS, LEAST_SCORE = 3, 3.5
"""A feature is used if so many positives have it, and so many standard errors more often than the unlabelled."""
STEPS, RATE, DECAY = 500, 0.05, 1e-5


def features(texts: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text, and the bounds of each text's part.

    Features are the words, A-Z lower-cased and without the signs around them, and their first
    4, 5 and 6 bytes, which stand for a stem with any ending. ``used`` marks the buckets to keep.
    """
    words = Words(texts, lower=True, breaks=NOT_LETTERS)
    mask, shift = np.int64((1 << BUCKET_BITS) - 1), np.uint64(64 - BUCKET_BITS)
    parts, docs = [], []
    for kind, size in enumerate((None, *PREFIXES)):
        hashes = words.hashes if size is None else mix(words.prefixes(size) + np.uint64(kind))
        buckets, doc = (hashes >> shift).astype(np.int64), words.doc
        if used is not None:
            kept = used[buckets]
            buckets, doc = buckets[kept], doc[kept]
        parts.append(buckets)
        docs.append(doc)
    pairs = np.unique((np.concatenate(docs) << BUCKET_BITS) | np.concatenate(parts))
    return (pairs & mask).astype(np.int32), np.searchsorted(pairs >> BUCKET_BITS, np.arange(len(texts) + 1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many positive and other texts of a task have each feature."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        for start, end in slices(batch.column("text")):
            part = batch.slice(start, end - start)
            buckets, bounds = features(part.column("text"))
            positive = np.repeat(part.column("positive").to_numpy(zero_copy_only=False), np.diff(bounds))
            counts[0] += np.bincount(buckets[positive], minlength=1 << BUCKET_BITS)
            counts[1] += np.bincount(buckets[~positive], minlength=1 << BUCKET_BITS)
    held = np.flatnonzero(counts.any(axis=0))
    for start in range(0, len(held), 50_000):
        own = held[start:start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[0][own]), pa.array(counts[1][own])], names=["bucket", "ours", "others"])


def _featured(used: np.ndarray):
    """The places in ``used`` of each text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = np.zeros(1 << BUCKET_BITS, bool)
        active[used] = True
        for batch in batches:
            for start, end in slices(batch.column("text")):
                part = batch.slice(start, end - start)
                buckets, bounds = features(part.column("text"), active)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.searchsorted(used, buckets).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("positive"), lists], names=["positive", "places"])

    return run


def train(positive: np.ndarray, places: np.ndarray, bounds: np.ndarray, count: int, prior: float) -> np.ndarray:
    """Weights of ``count`` features, and the constant as one weight more; steps of Adam on the whole sample."""
    ours, others = int(positive.sum()), int((~positive).sum())
    share = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not ours or not others:
        return np.append(np.zeros(count), share)
    doc = np.repeat(np.arange(len(positive)), np.diff(bounds))
    weights = np.append(np.zeros(count), share)
    mean, square = np.zeros(len(weights)), np.zeros(len(weights))
    pull = np.empty(len(positive))
    for step in range(1, STEPS + 1):
        logit = np.bincount(doc, weights[places], minlength=len(positive)) + weights[-1]
        chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        negative = np.logaddexp(0, logit[~positive]).mean() - prior * np.logaddexp(0, logit[positive]).mean()
        if negative >= 0:
            # The slopes of the loss as a positive and, corrected, as a negative add up to a constant.
            pull[positive] = -prior / ours
            pull[~positive] = chance[~positive] / others
        else:
            pull[positive] = prior * chance[positive] / ours
            pull[~positive] = -chance[~positive] / others
        slope = np.append(np.bincount(places, pull[doc], minlength=count) + DECAY * weights[:-1], pull.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        weights = weights - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return weights


def _sums(weights: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each text's weights, in an order that doesn't depend on the texts beside it."""
    return np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), weights[buckets], minlength=len(bounds) - 1)


def _scored(used: np.ndarray, weights: np.ndarray):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << BUCKET_BITS)
        table[used] = weights[:-1]
        active = table != 0
        for column in columns:
            out = []
            for start, end in slices(column):
                buckets, bounds = features(column.slice(start, end - start), active)
                logit = _sums(table, buckets, bounds) + weights[-1]
                out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """A column function: the score of a text column."""
    return F.arrow_udf(_scored(*model), "double")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Train on ``docs`` (doc_id, text) with the confirmed ids of ``labels`` (doc_id, toxic).

    The prior is the share of toxic ids among the labelled. At most ``positives`` and
    ``unlabelled`` texts are used, those with the smallest hash of the id.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known, toxic = labels.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ours = hash_sample(labels.where("toxic = 1").select("doc_id"), "doc_id", positives)
    # The unlabelled stand for all texts, so confirmed ones are not taken out.
    others = hash_sample(named.select("doc_id"), "doc_id", unlabelled)
    chosen = ours.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    # At most positives + unlabelled ids, so they go to every task.
    # An id that repeats is one text, so what is learned from has the bound of the ids.
    sample = one_text_each(named.join(F.broadcast(pin(chosen)), "doc_id"), ["doc_id", "positive"])
    ours, others = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    counts = sample.mapInArrow(_counted, "bucket long, ours long, others long").groupBy("bucket").agg(F.sum("ours").alias("ours"), F.sum("others").alias("others"))
    p, u = F.col("ours") / float(max(ours, 1)), F.col("others") / float(max(others, 1))
    errors = F.sqrt(p * (1 - p) / float(max(ours, 1)) + u * (1 - u) / float(max(others, 1)) + 1e-9)
    # No more than there are buckets, and of these only what marks the positives.
    telling = counts.where((F.col("ours") >= LEAST_TEXTS) & (p - u > LEAST_SCORE * errors)).select("bucket")
    used = np.sort(np.array([r[0] for r in telling.collect()], np.int64))
    rows = sample.mapInArrow(_featured(used), "positive boolean, places array<int>").toArrow().to_pylist()
    # The order in which rows arrive must not matter.
    rows.sort(key=lambda r: (r["positive"], r["places"]))
    places = np.array([n for r in rows for n in r["places"]], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(r["places"]) for r in rows])]).astype(np.int64)
    positive = np.array([r["positive"] for r in rows], bool)
    return used, train(positive, places, bounds, len(used), toxic / known if known else 0.0)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row of ``docs`` (doc_id, text).

    Learns only from ids that aren't held out; of rows that repeat an id from the smallest text. The score uses nothing
    but the text, whole and of any length; an empty, blank or null text has the score of no words, and equal texts
    have equal scores. Without any confirmed id all scores are near 0. Every row is answered, repeated ones and those
    without an id too; an empty table has no rows. Other columns of ``docs``, whatever their names, are left out.
    """
    learned = docs.where(~held_out(F.col("doc_id")))
    model = fit(learned, labels.where(~held_out(F.col("doc_id"))))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        scorer(model)(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
