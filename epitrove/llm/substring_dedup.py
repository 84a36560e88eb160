"""Cut word passages that an earlier document holds already.

A repeat of ``window`` words covers a whole block of ``(window + 1) // 2`` words wherever the blocks
of the other document begin. So the index holds each document's blocks that do not overlap, and the
probes are all its rolling windows of a block's length. A hit is grown word by word: every window
around it counts as repeated if an earlier document holds the same window, and repeated windows
that touch merge to maximal exact repeats.

Hits and windows are settled for all holders at once, never in pairs. Documents are dealt into
chunks of some megabytes by id. A chunk asks one question per distinct hash and hash range, as a
sorted list, and gets one bit per entry back:

* which of my rolling hashes are indexed, and seen in two documents? (46 bits of the hash, as
  differences; a false yes costs time only)
* for the windows around these: does a document before my own first one hold it? (128 further bits of hashes
  and the smallest id)

So a passage of a third of all documents is one entry per chunk. The texts are shuffled once, by
chunk; all three steps over texts read that shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from epitrove.llm.words import Words, ranges, slices

CHUNK_BYTES = 4_000_000
"""Text in a chunk; also text per hash range. A longer document is a chunk of its own or more."""

_BITS = 46
_BUCKETED = "bucket long, chunk long, list binary, wide boolean, index binary, many binary"
_WINDOWS = "bucket long, chunk long, list binary, more binary, ids binary"
_ANSWERS = "chunk long, kind int, bucket long, bits binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: ids and differences then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)


def _bounds(hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges begins in sorted hashes of ``bits`` bits."""
    edges = [min((n << bits) // buckets, (1 << bits) - 1) for n in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, np.uint64)), [len(hashes)]]).astype(np.int64)


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, and which of them each pair is."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return high[new], low[new], which


class _Chunk:
    """The windows of a chunk's documents: distinct block hashes, and the windows at each word."""

    def __init__(self, ids: np.ndarray, named: np.ndarray, texts: pa.Array, window: int) -> None:
        block = (window + 1) // 2
        short, long, more, doc, count, starts, aligned = [], [], [], [], [], [], []
        before = words_before = 0
        for start, end in slices(texts):
            words = Words(texts.slice(start, end - start))
            usable = named[start:end][words.doc] if len(words) else np.zeros(0, bool)
            hashes, at = words.windows(block, seed=1)
            keep = usable[at]
            hashes, at = hashes[keep] >> np.uint64(64 - _BITS), at[keep]
            short.append(hashes)
            starts.append(at + words_before)
            aligned.append((at - words.first[words.doc[at]]) % block == 0)
            hashes, at = words.windows(window, seed=2)
            for kept, values in ((long, hashes), (more, words.windows(window, seed=3)[0])):
                whole = np.zeros(len(words), np.uint64)
                whole[at] = values
                kept.append(whole)
            fits = np.zeros(len(words), bool)
            fits[at] = usable[at]
            count.append((words.counts, fits))
            doc.append(words.doc + before)
            before += end - start
            words_before += len(words)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.ids, self.window, self.block = ids, window, block
        self.counts = join([c for c, _ in count], np.int64)
        self.fits = join([f for _, f in count], bool)
        self.doc, self.long, self.more = join(doc, np.int64), join(long, np.uint64), join(more, np.uint64)
        self.starts, self.aligned = join(starts, np.int64), join(aligned, bool)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.short, self.place = np.unique(join(short, np.uint64), return_inverse=True)

    def flags(self) -> tuple[np.ndarray, np.ndarray]:
        """Per distinct block hash: is it the hash of an indexed block, and is it in two documents?"""
        indexed, many = np.zeros(len(self.short), bool), np.zeros(len(self.short), bool)
        indexed[self.place[self.aligned]] = True
        holder = np.zeros(len(self.short), np.int64)
        doc = self.doc[self.starts]
        holder[self.place] = doc
        many[self.place[holder[self.place] != doc]] = True
        return indexed, many

    def candidates(self, hits: np.ndarray) -> None:
        """The windows that hold a hit block: ``at``, their distinct hashes, and the first id of each."""
        marks = np.zeros(len(self.doc) + 1, np.int64)
        marks[1:][self.starts[hits[self.place]]] = 1
        np.cumsum(marks, out=marks)
        last = np.minimum(np.arange(len(self.doc)) + self.window - self.block + 1, len(self.doc))
        self.at = np.flatnonzero(self.fits & (marks[last] > marks[:-1]))
        self.windows, self.rest, self.which = _distinct(self.long[self.at], self.more[self.at])
        self.least = np.full(len(self.windows), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, self.ids[self.doc[self.at]])

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """The words in a window that a document with a smaller id holds."""
        repeated = self.at[earlier[self.which] | (self.ids[self.doc[self.at]] > self.least[self.which])]
        steps = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(steps, repeated, 1)
        np.subtract.at(steps, repeated + self.window, 1)
        return np.cumsum(steps[:-1]) > 0


def _read(table: pa.Table, window: int) -> tuple[int, pa.Array, _Chunk]:
    table = table.combine_chunks()
    texts = table["text"].combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    ids = table["doc_id"].combine_chunks()
    named = ~np.asarray(ids.is_null())
    return table["chunk"][0].as_py(), texts, _Chunk(np.asarray(ids.fill_null(0), dtype=np.int64), named, texts, window)


def _ask(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        number, _, chunk = _read(table, window)
        indexed, many = chunk.flags()
        bounds = _bounds(chunk.short, buckets, _BITS)
        rows = []
        for bucket in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[bucket], bounds[bucket + 1])
            steps = np.diff(chunk.short[part], prepend=np.uint64((int(bucket) << _BITS) // buckets))
            wide = bool(steps.max() >> np.uint64(32))
            rows.append((int(bucket), number, _planes(steps if wide else steps.astype(np.uint32)), wide, _bits(indexed[part]), _bits(many[part])))
        return _table(rows, _BUCKETED)

    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[n] for r in rows], kinds[kind]) for n, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])


def _hit(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        base = np.uint64((rows[0]["bucket"] << _BITS) // buckets)
        lists = [np.cumsum(_values(r["list"], np.uint64 if r["wide"] else np.uint32), dtype=np.uint64) + base for r in rows]
        sizes = [len(x) for x in lists]
        hashes, place, held = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        indexed, many = np.zeros(len(hashes), bool), held > 1
        indexed[place[np.concatenate([_flags(r["index"], n) for r, n in zip(rows, sizes)])]] = True
        many[place[np.concatenate([_flags(r["many"], n) for r, n in zip(rows, sizes)])]] = True
        hits = np.split((indexed & many)[place], np.cumsum(sizes)[:-1])
        return _table([(r["chunk"], 1, r["bucket"], _bits(h)) for r, h in zip(rows, hits) if h.any()], _ANSWERS)

    return run


def _answered(size: int, bounds: np.ndarray, answers: pa.Table, kind: int) -> np.ndarray:
    out = np.zeros(size, bool)
    for row in answers.to_pylist():
        if row["kind"] == kind:
            low, high = bounds[row["bucket"]], bounds[row["bucket"] + 1]
            out[low:high] = _flags(row["bits"], high - low)
    return out


def _grow(window: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return _table([], _WINDOWS)
        number, _, chunk = _read(table, window)
        chunk.candidates(_answered(len(chunk.short), _bounds(chunk.short, buckets, _BITS), answers, 1))
        bounds = _bounds(chunk.windows, buckets, 64)
        rows = []
        for bucket in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[bucket], bounds[bucket + 1])
            rows.append((int(bucket), number, chunk.windows[part].tobytes(), chunk.rest[part].tobytes(), _planes(chunk.least[part])))
        return _table(rows, _WINDOWS)

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """Which windows of a chunk does another chunk hold in a document with a smaller id?"""
    rows = table.to_pylist()
    lists = [np.frombuffer(r["list"], np.uint64) for r in rows]
    ids = np.concatenate([_values(r["ids"], np.int64) for r in rows])
    hashes, _, place = _distinct(np.concatenate(lists), np.concatenate([np.frombuffer(r["more"], np.uint64) for r in rows]))
    least = np.full(len(hashes), np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids)
    earlier = np.split(least[place] < ids, np.cumsum([len(x) for x in lists])[:-1])
    return _table([(r["chunk"], 2, r["bucket"], _bits(e)) for r, e in zip(rows, earlier)], _ANSWERS)


def _cut(window: int, buckets: int, verbatim: bool, rest: list[str]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        _, texts, chunk = _read(table, window)
        answered = answers.to_pylist()
        chunk.candidates(_answered(len(chunk.short), _bounds(chunk.short, buckets, _BITS), answers, 1)
                         if answered else np.zeros(len(chunk.short), bool))
        gone = chunk.covered(_answered(len(chunk.windows), _bounds(chunk.windows, buckets, 64), answers, 2))
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.first])
        kept, spans = [], []
        for n, text in enumerate(texts):
            text = text.as_py() or ""
            words = slice(chunk.first[n], chunk.first[n + 1])
            if removed[n] or not verbatim:
                held = text.encode().split()
                text = b" ".join(compress(held, ~gone[words]) if removed[n] else held).decode()
            kept.append(text)
            edges = np.flatnonzero(np.diff(gone[words].astype(np.int8), prepend=0, append=0)) if removed[n] else np.zeros(0, np.int64)
            spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
        return pa.table([table["doc_id"], pa.array(chunk.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *[table[c] for c in rest]],
                        names=["doc_id", "n_words", "n_removed", "kept_text", "repeats", *rest])

    return run


def cut_repeats(docs: DataFrame, window: int = 13, verbatim: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, …) without the passages that an earlier document holds.

    Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (the words left, joined by one space;
    with ``verbatim`` a text that loses nothing stays as it is), ``repeats`` (the ranges of words cut, as
    start and end) and ``row``, a struct of the input's other columns. A word goes if a window of ``window`` words around it also
    starts in a document with a smaller doc_id, judged on the texts as they came. Null texts count
    as empty. Rows without an id lose nothing and cut nothing. Rows that repeat an id are one
    document: they do not cut each other.
    """
    buckets = chunks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES))
    others = [f for f in docs.schema.fields if f.name.lower() not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{f.name}`").alias(f"c{n}") for n, f in enumerate(others)]) if others else None
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        *([row.alias("row")] if others else []))
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition("chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(window, buckets), _BUCKETED)
    hits = asked.groupBy("bucket").applyInArrow(_hit(buckets), _ANSWERS)
    grown = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_grow(window, buckets), _WINDOWS)
    earlier = grown.groupBy("bucket").applyInArrow(_earlier, _ANSWERS)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType()),
                           T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                           *([named.schema["row"]] if others else [])])
    cut = dealt.groupBy("chunk").cogroup(hits.unionByName(earlier).groupBy("chunk")).applyInArrow(
        _cut(window, buckets, verbatim, ["row"] if others else []), schema)
    if not others:
        return cut
    return cut.withColumn("row", F.struct(*[F.col("row")[f"c{n}"].alias(f.name) for n, f in enumerate(others)]))
