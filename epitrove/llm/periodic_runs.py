"""Find every stretch of words that repeats with a period, and keep its first period only.

Two words that lie ``q`` apart and are equal are a match of period q; a run is a maximal stretch of matches and the
q words after it. Periods are taken by octaves. In an octave that begins with P, a run has at least P
matches, so one of them lies on a boundary, a multiple of P. A document is exploded into tiles, one for each
octave and boundary, that overlap: P words before their boundary and three times P after it. A tile is solved
by itself: for each period of the octave two values of the Z-function at its boundary, forwards and backwards, say how far
the words go on to match, at most P words either way. These fragments touch where a run crosses a boundary,
so they are shuffled by document and period and stitched to intervals. Of equal intervals the smallest period counts.

Tiles of one document stay where it is read until it is longer than ``LONG_BYTES``; the tiles of a longer one
are dealt to tasks in bundles of neighbours, and only the ids of their words travel.

The Z-values of all tiles are worked out together: a block of 2^k words gets a name from the names of its
halves, equal exactly for equal blocks, and a common beginning is found by halving.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from epitrove.plans.storage import pin

LONG_BYTES = 4_000_000
BUNDLE_WORDS = 65_536
SLICE_BYTES = 1_200_000
"""Documents of one call are solved together in slices of at most so many bytes; a longer one by itself."""
_PAIRS = 4_000_000

_FRAGMENTS = "key binary, period long, start long, end long"
_BUNDLES = "key binary, first int, last int, lo long, hi long, base long, ids binary"
_TILES = "key binary, period long, start long, end long, first int, last int, lo long, hi long, base long, ids binary"


def word_ids(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each text as numbers; equal words have equal numbers within one call."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    return [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)) for words in (text.split() for text in texts)]


def octaves(least: int, words: int) -> list[tuple[int, int, int]]:
    """Smallest and largest period, and the distance of boundaries, of each octave for documents of so many words."""
    step = 1 << ((max(least, 2) + 1) // 2).bit_length() - 1
    found = [(1, 2 * step - 1, step)]
    while 4 * step <= words:
        step *= 2
        found.append((step, 2 * step - 1, step))
    return found


class _Names:
    """Names of the blocks of 1, 2, 4, … words that begin at each word, built when they are asked for."""

    def __init__(self, ids: np.ndarray) -> None:
        self.levels = [ids]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, names = 1 << len(self.levels) - 1, self.levels[-1].astype(np.int64)
            if len(names) <= half:
                self.levels.append(np.zeros(0, np.int32))
                continue
            pairs = names[:-half] * (int(names.max()) + 1) + names[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        return self.levels[k]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on; at most ``most``, of which none is above ``step``."""
        length = np.zeros(len(a), np.int64)
        for k in range(step.bit_length() - 1, -1, -1):
            held = np.flatnonzero(length + (1 << k) <= most)
            names = self.level(k)
            same = names[(a + length)[held]] == names[(b + length)[held]]
            length[held[same]] += 1 << k
        return length

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``."""
        length = np.zeros(len(a), np.int64)
        for k in range(step.bit_length() - 1, -1, -1):
            held = np.flatnonzero(length + (1 << k) <= most)
            names, back = self.level(k), length + (1 << k)
            same = names[(a - back)[held]] == names[(b - back)[held]]
            length[held[same]] += 1 << k
        return length


def solve(ids: np.ndarray, bounds: np.ndarray, scales: list[tuple[int, int, int]], lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """Fragments (period, start, end) of matches of the tiles whose boundaries lie in [lo, hi).

    ``ids`` holds the words of documents (or parts) that begin at ``bounds``, the last of which is the end.
    Touching fragments of one document and period are joined.
    """
    names, found = _Names(ids), [np.zeros((3, 0), np.int64)]
    for low, high, step in scales:
        grid = np.arange(-(-lo // step) * step, hi, step)
        doc = np.searchsorted(bounds, grid, "right") - 1
        usable = (bounds[doc + 1] - grid) > low
        grid, doc = grid[usable], doc[usable]
        if not len(grid):
            continue
        width = high - low + 1
        padded = np.concatenate([ids, np.full(high + 1, -1, ids.dtype)])
        after = np.lib.stride_tricks.sliding_window_view(padded, width)
        for at in range(0, len(grid), max(1, _PAIRS // width)):
            part = slice(at, at + max(1, _PAIRS // width))
            row, period = np.nonzero(after[grid[part] + low] == ids[grid[part]][:, None])
            a, of = grid[part][row], doc[part][row]
            b = a + period + low
            inside = b < bounds[of + 1]
            a, b, of = a[inside], b[inside], of[inside]
            ahead = names.forward(a, b, np.minimum(step, bounds[of + 1] - b), step)
            behind = names.backward(a, b, np.minimum(step, a - bounds[of]), step)
            # A run has ``step`` matches or more, so a boundary in it has as many around it within the tile.
            kept = ahead + behind >= step
            found.append(np.stack([b - a, a - behind, a + ahead])[:, kept])
    return _joined(np.concatenate(found, axis=1), bounds)


def _joined(fragments: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments of one period that touch or overlap as one; documents don't touch, as a match has a word after it."""
    period, start, end = fragments[:, np.lexsort((fragments[2], fragments[1], fragments[0]))]
    if not len(period):
        return period, start, end
    # Ends ascend with starts, as fragments of one stretch come from one boundary after the other.
    new = np.ones(len(period), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > end[:-1])
    return period[new], start[new], np.maximum.reduceat(end, np.flatnonzero(new))


def _long_enough(period: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    return end - start >= np.maximum(period, least - period)


def _table(schema: str, **columns) -> pa.RecordBatch:
    """The given columns of equal length, and nulls for the others of a schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    count = max(map(len, columns.values()))
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(count, kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _solve_here(keys: list[bytes], texts: list[bytes], least: int) -> pa.RecordBatch:
    """The fragments of the tiles of whole documents."""
    words = word_ids(texts)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    period, start, end = solve(np.concatenate(words), bounds, octaves(least, max(len(w) for w in words)), 0, int(bounds[-1]))
    kept = _long_enough(period, start, end, least)
    period, start, end = period[kept], start[kept], end[kept]
    doc = np.searchsorted(bounds, start, "right") - 1
    return _table(_TILES, key=[keys[d] for d in doc], period=period, start=start - bounds[doc], end=end - bounds[doc])


def bundles(words: int, least: int, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """First and last octave, boundaries [lo, hi), and words [base, to) of each bundle of tiles of a document.

    The octaves whose tiles are small against ``size`` share bundles; each larger octave has its own, of four tiles or more.
    """
    scales, found = octaves(least, words), []
    small = max(1, sum(4 * step <= size for _, _, step in scales))
    for first, last in [(0, small - 1)] + [(k, k) for k in range(small, len(scales))]:
        step, high = scales[last][2], scales[last][1]
        length = max(size, 4 * step) // step * step
        found += [(first, last, lo, min(lo + length, words), max(0, lo - step), min(words, lo + length + high + step)) for lo in range(0, words, length)]
    return found


def _tiles(least: int, long_bytes: int, size: int):
    """Fragments of documents of usual length, solved in slices of documents of about equal length; bundles of longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), _texts(batch)
            order, taken = sorted(range(len(texts)), key=lambda n: len(texts[n])), []
            while order and len(texts[order[-1]]) > long_bytes:
                n = order.pop()
                ids = word_ids([texts[n]])[0]
                for first, last, lo, hi, base, to in bundles(len(ids), least, size):
                    yield _table(_TILES, key=[keys[n]], first=[first], last=[last], lo=[lo], hi=[hi], base=[base], ids=[ids[base:to].tobytes()])
            held = 0
            while order:
                taken.append(order.pop())
                held += len(texts[taken[-1]])
                if not order or held + len(texts[order[-1]]) > SLICE_BYTES:
                    yield _solve_here([keys[n] for n in taken], [texts[n] for n in taken], least)
                    taken, held = [], 0

    return run


def _dealt(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                key, first, last, lo, hi, base, ids = (column[row].as_py() for column in batch.columns)
                ids = np.frombuffer(ids, np.int32)
                # ``base`` is a multiple of the largest step, so boundaries are multiples here, too.
                period, start, end = solve(ids, np.array([0, len(ids)]), octaves(least, 1 << 62)[first:last + 1], lo - base, hi - base)
                start, end = start + base, end + base
                # What may go on in a neighbouring bundle is kept, however short.
                kept = _long_enough(period, start, end, least) | (start < lo) | (end >= hi)
                yield _table(_FRAGMENTS, key=[key] * int(kept.sum()), period=period[kept], start=start[kept], end=end[kept])

    return run


def find_runs(texts: DataFrame, least: int = 12) -> DataFrame:
    """``key``, ``start``, ``length``, ``period`` (in words) of every run in ``texts`` (key, text), of ``least`` words or more.

    A run is a stretch of words whose smallest period is ``period``, at least twice as long as that, that can't be
    extended. Rows that repeat a key must repeat its text. Null texts have no words.
    """
    tiles = pin(texts.select("key", "text").mapInArrow(_tiles(least, LONG_BYTES, BUNDLE_WORDS), _TILES))
    fragment, bundle = ([c.split()[0] for c in schema.split(", ")] for schema in (_FRAGMENTS, _BUNDLES))
    bundles_left = tiles.where("ids IS NOT NULL").select(*bundle).dropDuplicates(["key", "first", "lo"]).repartition("key", "first", "lo")
    fragments = tiles.where("ids IS NULL").select(*fragment).unionByName(bundles_left.mapInArrow(_dealt(least), _FRAGMENTS)).distinct()
    # A document has one fragment per bundle and stretch, so no group is larger than its document.
    before = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    stitched = fragments.withColumn("fresh", F.when(F.col("start") <= reached, 0).otherwise(1))
    stitched = stitched.withColumn("stretch", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = stitched.groupBy("key", "period", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    stitched = stitched.where(F.col("end") - F.col("start") >= F.greatest(F.col("period"), F.lit(least) - F.col("period")))
    lengths = stitched.select("key", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), "period")
    return lengths.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, kept = [], []
        for text, runs in zip(_texts(batch), batch.column("runs").to_pylist()):
            words = text.split()
            if runs:
                steps = np.zeros(len(words) + 1, np.int64)
                for run in runs:
                    steps[run["start"] + run["period"]] += 1
                    steps[run["start"] + run["length"]] -= 1
                words, total = compress(words, (np.cumsum(steps[:-1]) == 0).tolist()), len(words)
                counts.append(total)
            else:
                counts.append(len(words))
            kept.append(b" ".join(words))
        columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "runs": batch.column("runs"),
                   "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        more = {"row": batch.column("row")} if "row" in batch.schema.names else {}
        yield pa.RecordBatch.from_pydict({**columns, **more})


def collapse_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, …) with its periodic runs, and its text with the first period of each only.

    Returns ``doc_id``, ``n_words``, ``runs`` (start, length, period in words, by start and period), ``kept_text`` (the
    words left, joined by one space) and ``row``, a struct of the input's other columns, whatever their names. A word
    goes if any run holds it after that run's first period. Null, empty and blank texts have no words and no runs.
    Repeated rows and null ids are answered one by one; runs that share a start are ordered by period. Texts may have any
    length that a row can: above ``LONG_BYTES`` one text is solved by many tasks.
    """
    others = [f for f in docs.schema.fields if f.name.lower() not in ("doc_id", "text")]
    row = [F.struct(*[F.col(f"`{f.name}`").alias(f"c{n}") for n, f in enumerate(others)]).alias("row")] if others else []
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row)
    named = named.withColumn("key", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256)))
    found = find_runs(named.select("key", "text"), least).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    # Stored, so that it meets the texts as a table of known size.
    joined = named.join(pin(found), "key", "left").drop("key")
    run = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    joined = joined.withColumn("runs", F.coalesce("runs", F.array().cast(run)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", run),
                           T.StructField("kept_text", T.StringType()), *([named.schema["row"]] if others else [])])
    kept = joined.mapInArrow(_collapse, schema)
    if not others:
        return kept
    return kept.withColumn("row", F.struct(*[F.col("row")[f"c{n}"].alias(f.name) for n, f in enumerate(others)]))
