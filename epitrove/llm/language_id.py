"""Language of a text by a convolutional network over its bytes, trained in numpy.

A text is cut into windows of ``WINDOW`` bytes. Bytes are embedded; filters of two, three and four
bytes slide over a window; each keeps its largest answer; a softmax over these gives the window's
language. A text's chances are the mean over all its windows, weighted by their letters.

Training takes at most ``TEXTS`` texts of a language (smallest hash of the id) and ``WINDOWS``
evenly spread windows of each. For use, embedding and filters are multiplied out to tables from bytes and
pairs of bytes to filter answers, so a text costs look-ups, sums and maxima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from epitrove.llm.folds import below_share, held_out, sample_order
from epitrove.llm.words import LOWER, NOT_LETTERS, slices, text_bytes
from epitrove.plans.storage import pin

WINDOW = 128
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 16, 8
TEXTS, WINDOWS = 1_500, 6
EPOCHS, BATCH, RATE = 6, 256, 0.01
UNKNOWN = "und"
_AT_ONCE = 2_048


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals among U+00C0 to U+00DE in lower case."""
    data = LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 32
    return data


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each filled up with spaces, and the text of each."""
    data, offsets = text_bytes(texts)
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), count)
    out = np.full(len(doc) * WINDOW, 32, np.uint8)
    first = np.cumsum(count) - count
    shift = np.repeat(first * WINDOW - offsets[:-1], lengths)
    out[np.arange(len(data)) + shift] = lower_bytes(data)
    return out.reshape(-1, WINDOW), doc


class Network:
    """Parameters: ``bytes`` (256 x depth), one ``filter`` for each width (width, depth, filters), biases, and the last layer."""

    def __init__(self, classes: int, seed: int = 3) -> None:
        random = np.random.default_rng(seed)
        self.values = {"bytes": random.normal(0, 0.3, (256, DEPTH)), "out": random.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)), "shift": np.zeros(classes)}
        for width in WIDTHS:
            self.values[f"filter{width}"] = random.normal(0, (width * DEPTH) ** -0.5, (width, DEPTH, FILTERS))
            self.values[f"bias{width}"] = np.zeros(FILTERS)

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Chances, pooled answers before the rectifier, and where each filter was largest."""
        pooled, places = [], {}
        for width in WIDTHS:
            answers = self.values[f"bias{width}"]
            for place in range(width):
                answers = answers + (self.values["bytes"] @ self.values[f"filter{width}"][place])[rows[:, place:WINDOW - width + 1 + place]]
            places[width] = answers.argmax(axis=1)
            pooled.append(np.take_along_axis(answers, places[width][:, None, :], 1)[:, 0, :])
        pooled = np.concatenate(pooled, axis=1)
        logits = np.maximum(pooled, 0) @ self.values["out"] + self.values["shift"]
        chances = np.exp(logits - logits.max(axis=1, keepdims=True))
        return chances / chances.sum(axis=1, keepdims=True), pooled, places

    def slopes(self, rows: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
        chances, pooled, places = self.forward(rows)
        chances[np.arange(len(rows)), classes] -= 1
        chances /= len(rows)
        back = (chances @ self.values["out"].T) * (pooled > 0)
        found = {"out": np.maximum(pooled, 0).T @ chances, "shift": chances.sum(axis=0), "bytes": np.zeros((256, DEPTH))}
        for n, width in enumerate(WIDTHS):
            own = back[:, n * FILTERS:(n + 1) * FILTERS]
            found[f"bias{width}"] = own.sum(axis=0)
            # Only the place where a filter was largest carries a slope.
            held = rows[np.arange(len(rows))[:, None, None], places[width][:, :, None] + np.arange(width)]
            found[f"filter{width}"] = np.einsum("bf,bfwd->wdf", own, self.values["bytes"][held])
            to_bytes = np.einsum("bf,wdf->bfwd", own, self.values[f"filter{width}"])
            for depth in range(DEPTH):
                found["bytes"][:, depth] += np.bincount(held.ravel(), to_bytes[..., depth].ravel(), minlength=256)
        return found


def train(rows: np.ndarray, classes: np.ndarray, count: int, seed: int = 5) -> Network:
    network, random = Network(count), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in network.values.items()}
    square = {k: np.zeros_like(v) for k, v in network.values.items()}
    step = 0
    for _ in range(max(EPOCHS, -(-200 * BATCH // max(len(rows), 1)))):
        order = random.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            step += 1
            chosen = order[start:start + BATCH]
            for name, slope in network.slopes(rows[chosen], classes[chosen]).items():
                mean[name] = 0.9 * mean[name] + 0.1 * slope
                square[name] = 0.999 * square[name] + 0.001 * slope * slope
                network.values[name] -= RATE * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
    return network


class Tables:
    """A trained network as sums of look-ups: for pairs of bytes, and for the third byte of a filter of three."""

    def __init__(self, network: Network) -> None:
        single = {(w, p): (network.values["bytes"] @ network.values[f"filter{w}"][p]).astype(np.float32) for w in WIDTHS for p in range(w)}
        self.pairs = {(w, p): (single[w, p][:, None, :] + single[w, p + 1][None, :, :]).reshape(65536, FILTERS) for w in WIDTHS for p in range(0, w - 1, 2)}
        self.last = {w: single[w, w - 1] for w in WIDTHS if w % 2}
        self.bias = {w: network.values[f"bias{w}"].astype(np.float32) for w in WIDTHS}
        self.out, self.shift = network.values["out"], network.values["shift"]

    def chances(self, rows: np.ndarray) -> np.ndarray:
        two = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        pooled = []
        for width in WIDTHS:
            length = WINDOW - width + 1
            answers = self.pairs[width, 0][two[:, :length]]
            for place in range(2, width - 1, 2):
                answers += self.pairs[width, place][two[:, place:place + length]]
            if width % 2:
                answers += self.last[width][rows[:, width - 1:width - 1 + length]]
            pooled.append(answers.max(axis=1) + self.bias[width])
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.shift
        chances = np.exp(logits - logits.max(axis=1, keepdims=True))
        return chances / chances.sum(axis=1, keepdims=True)


def _predicted(network: Network, names: list[str]):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = Tables(network)
        for column in columns:
            best, score = [], []
            for start, end in slices(column):
                rows, doc = windows(column.slice(start, end - start))
                sums, weights = np.zeros((end - start, len(names))), np.zeros(end - start)
                for low in range(0, len(rows), _AT_ONCE):
                    part, of = rows[low:low + _AT_ONCE], doc[low:low + _AT_ONCE]
                    letters = (~NOT_LETTERS[part]).sum(axis=1) + 1e-3
                    np.add.at(sums, of, tables.chances(part) * letters[:, None])
                    np.add.at(weights, of, letters)
                sums /= np.maximum(weights, 1e-9)[:, None]
                best.append(sums.argmax(axis=1))
                score.append(sums.max(axis=1))
            best, score = np.concatenate(best) if best else np.zeros(0, int), np.concatenate(score) if score else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array([names[n] for n in best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["lang", "score"])

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in slices(batch.column("text")):
            part = batch.slice(start, end - start)
            rows, doc = windows(part.column("text"))
            count = np.bincount(doc, minlength=len(part))
            first = np.cumsum(count) - count
            chosen, of = [], []
            for n in np.flatnonzero(count):
                spread = np.unique(np.linspace(0, count[n] - 1, min(WINDOWS, count[n])).astype(int))
                chosen.append(first[n] + spread)
                of.append(np.full(len(spread), n))
            chosen = np.concatenate(chosen) if chosen else np.zeros(0, int)
            of = np.concatenate(of) if of else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(of)), pa.array([r.tobytes() for r in rows[chosen]], pa.binary())], names=["lang", "bytes"])


def fit(docs: DataFrame, texts: int = TEXTS) -> tuple[Network, list[str]]:
    """Train on ``docs`` (doc_id, text, lang): at most ``texts`` texts of each language."""
    named = docs.where("doc_id is not null and text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    named = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ids = named.select("doc_id", "lang")
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    ranked = Window.partitionBy("lang").orderBy(sample_order("doc_id"), "doc_id")
    # One row per language; the network, which goes to every task as well, has a class for each.
    few = ids.join(F.broadcast(counts), "lang").where(below_share("doc_id", texts, F.col("texts"))).select("doc_id", "lang")
    chosen = pin(few.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= texts).select("doc_id").distinct())
    # At most ``texts`` ids of a language, and one row of each.
    learned = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.*")
    rows = learned.mapInArrow(_sampled, "lang string, bytes binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["bytes"]))
    names = sorted({r["lang"] for r in rows})
    if not names:
        return Network(1), [UNKNOWN]
    inputs = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(inputs, np.array([names.index(r["lang"]) for r in rows]), len(names)), names


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for each row of ``docs`` (doc_id, text, lang).

    Learns only from ids that aren't held out and have a language; of rows that repeat an id from the one with the smallest
    language and text. ``lang_pred`` is a language that was learned, or ``und`` with score 1 for a text that is null
    or has no letter. If nothing can be learned every text is ``und``. Texts are read whole, in windows of fixed length; of
    languages that tie the first in alphabetical order counts. Every row is answered, repeated ones and those without an id
    too. Other columns of ``docs``, whatever their names, are left out.
    """
    network, names = fit(docs.where(~held_out(F.col("doc_id"))))
    predict = F.arrow_udf(_predicted(network, names), "lang string, score double")
    text = F.col("text").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), lettered.alias("lettered"), predict(text).alias("found"))
    return found.select("doc_id", "held_out", F.when(F.col("lettered"), F.col("found.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                        F.when(F.col("lettered"), F.col("found.score")).otherwise(1.0).alias("score"))
