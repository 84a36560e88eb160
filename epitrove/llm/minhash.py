"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate links.

1. Each document's set of word shingles is hashed once. The top bits of a hash name one of 128 bins
   and each bin keeps its smallest hash; empty bins borrow from a full bin by a hash of the bin and
   the attempt (optimal densification). Five bins make a band: 25 bands, 25 bucket keys.
2. Documents with equal sets are one class with one representative from here on.
3. Each bucket links its members to its smallest one: as many links as members, however large the
   bucket. Their components are families; documents that share a bucket share the family.
4. Families are compared in full, in blocks of a bounded number of documents and bytes. Blocks report the
   components they find, not pairs. A family larger than a block first meets some of its members
   (about ``ANCHORS``) and its own block, so copies hang together from here on. Afterwards only buckets that still hold
   different components are compared, each by itself; of buckets with the same members one is. So a
   large family of documents that are related but not linked takes work in proportion to its buckets, not to its pairs.

A pair at similarity 0.85 shares no bucket with a chance of 4e-7, one at 0.8 with 5e-5.

Texts are shipped once for each block they are in. ``doc_id`` identifies a document: rows that
repeat it are versions of one document. Null ids are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from epitrove.llm.components import components
from epitrove.llm.words import Words, mix, ranges, slices
from epitrove.plans.storage import pin

BINS, ROWS = 128, 5
BANDS = BINS // ROWS
BLOCK = 192
BLOCK_BYTES = 4_000_000
"""Documents and bytes of text that a block holds on average; a longer document is compared by itself with few others."""
ANCHORS = 16
_ATTEMPTS = 512
_COLUMNS = 16_384


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the bounds of each document's part."""
    words = Words(texts, lower=True)
    hashes, at = words.windows(size)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        hashes, doc = np.concatenate([hashes, words.whole()[short]]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def _probes() -> np.ndarray:
    """The bins that an empty bin tries, in order; at last every bin in turn."""
    bins, attempts = np.arange(BINS, dtype=np.uint64)[:, None], np.arange(_ATTEMPTS, dtype=np.uint64)[None, :]
    tried = (mix(bins * np.uint64(_ATTEMPTS) + attempts + np.uint64(0x51ED2701)) % np.uint64(BINS)).astype(np.int64)
    rest = (np.arange(BINS)[:, None] + np.arange(1, BINS + 1)[None, :]) % BINS
    return np.concatenate([tried, rest], axis=1)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of bin minima per document; a document without shingles has zeros."""
    count = len(bounds) - 1
    doc = np.repeat(np.arange(count), np.diff(bounds))
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (doc[1:] != doc[:-1])
    out, full = np.zeros((count, BINS), np.uint64), np.zeros((count, BINS), bool)
    out[doc[first], bins[first]] = hashes[first]
    full[doc[first], bins[first]] = True
    row, empty = np.nonzero(~full & (np.diff(bounds) > 0)[:, None])
    for tried in _probes().T:
        if not len(row):
            break
        found = full[row, tried[empty]]
        out[row[found], empty[found]] = out[row[found], tried[empty[found]]]
        row, empty = row[~found], empty[~found]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signature), band + 1, np.uint64)
        for value in signature[:, band * ROWS:(band + 1) * ROWS].T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + value)
        keys[:, band] = key
    return keys


def _sketches(size: int):
    names = ["doc_id", "n_bytes", "n_shingles", "mark", "check", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column("text")):
                hashes, bounds = shingle_sets(batch.column("text").slice(start, end - start), size)
                counts = np.diff(bounds)
                sums = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(hashes, out=sums[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
                keys = band_keys(signatures(hashes, bounds))[counts > 0].view(np.int64).ravel()
                places = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)
                marks = [pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, end - start), batch.column("n_bytes").slice(start, end - start), pa.array(counts, pa.int64()), *marks,
                    pa.ListArray.from_arrays(pa.array(places), pa.array(keys)),
                ], names=names)

    return run


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, bytes of text, set size, two 64-bit sums that identify the set, and its bucket keys (none if empty)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(
        _sketches(size), "doc_id long, n_bytes long, n_shingles long, mark long, check long, bands array<long>")


def _labels(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches over a symmetric boolean matrix."""
    labels = np.arange(len(linked))
    while True:
        near = np.where(linked, labels[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(labels, near)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def overlaps(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of some sets: products of 0/1 matrices over shingles that two sets hold."""
    count = len(bounds) - 1
    doc = np.repeat(np.arange(count), np.diff(bounds))
    values, place, often = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = often > 1
    place, doc = (np.cumsum(shared) - 1)[place][shared[place]], doc[shared[place]]
    order = np.argsort(place, kind="stable")
    place, doc = place[order], doc[order]
    out = np.zeros((count, count), np.int64)
    for low in range(0, int(shared.sum()), _COLUMNS):
        start, end = np.searchsorted(place, [low, low + _COLUMNS])
        held = np.zeros((count, min(_COLUMNS, int(shared.sum()) - low)), np.float32)
        held[doc[start:end], place[start:end] - low] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def _confirm(size: int, percent: int):
    """Links between documents of a group that are in the same set ``part`` and similar enough, as a forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, texts = table["doc_id"].to_numpy(), table["text"].combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        parts = table["part"].to_numpy()
        pieces, sizes = [], []
        for start, end in slices(texts):
            hashes, bounds = shingle_sets(texts.slice(start, end - start), size)
            pieces.append(hashes)
            sizes.append(np.diff(bounds))
        hashes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        begins = np.cumsum(counts) - counts
        order = np.lexsort((ids, parts))
        a, b = [], []
        for members in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1) if len(order) else []:
            if len(members) < 2:
                continue
            own = counts[members]
            both = overlaps(hashes[ranges(begins[members], own)], np.concatenate([[0], np.cumsum(own)]))
            linked = (100 * both >= percent * (own[:, None] + own[None, :] - both)) & (own[:, None] > 0) & (own[None, :] > 0)
            least = _labels(linked)
            far = least != np.arange(len(members))
            a.append(ids[members[least[far]]])
            b.append(ids[members[far]])
        return pa.table({"a": pa.array(np.concatenate(a) if a else [], pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})

    return run


def _confirmed(placed: DataFrame, size: int, percent: int) -> DataFrame:
    """``placed``: bundle, part, doc_id, text. A bundle is what one call compares."""
    return placed.groupBy("bundle").applyInArrow(_confirm(size, percent), "a long, b long")


def _blocks(rows: str, size: str) -> F.Column:
    """How many blocks hold so many documents of so many bytes."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES))


def _block(of: str, among: str) -> F.Column:
    """A block number below ``among``, by hash."""
    return F.pmod(F.xxhash64(of), F.col(among))


def _bundled(small: DataFrame, unit: str) -> F.Column:
    """Which bundle of about a block each unit that is no larger than one goes to; ``small`` has n and size of each unit."""
    n, size = small.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.pmod(F.xxhash64(unit), F.lit(max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))).cast("long"))


def open_buckets(shared: DataFrame) -> DataFrame:
    """Of ``shared`` (bucket, node, n_bytes, component) the buckets that hold several components, one of those with equal members.

    Each has ``n`` members of ``size`` bytes and ``blocks``.
    """
    members = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"members{seed}") for seed in (1, 2)]
    held = shared.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("node").alias("first"),
                                        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size"), *members)
    held = held.where("least < most").groupBy("first", "n", "members1", "members2").agg(F.min("bucket").alias("bucket"), F.min("size").alias("size"))
    return held.select("bucket", "n", "size", _blocks("n", "size").alias("blocks"))


def second_pass(shared: DataFrame, buckets: DataFrame) -> DataFrame:
    """``bundle``, ``part``, ``node``: who is compared with whom in ``buckets``, the open ones of ``shared``.

    Buckets up to a block are compared outright, several to a bundle. In a larger one all blocks meet
    that don't hold one and the same component: work that grows with the square of a bucket that falls apart.
    """
    met = shared.join(buckets.select("bucket", "blocks"), "bucket")
    small, large = met.where("blocks = 1"), met.where("blocks > 1")
    bundle = _bundled(buckets.where("blocks = 1"), "bucket")
    placed = small.select(bundle.cast("string").alias("bundle"), F.col("bucket").alias("part"), "node")
    if buckets.where("blocks > 1").isEmpty():
        return placed
    held = large.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size"))
    held = pin(held.withColumn("own", _blocks("n", "size")))
    strays = held.where("own = 1").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).select("bucket", _blocks("n", "size").alias("strays"))
    block = F.when(F.col("own") > 1, F.concat_ws("/", "component", _block("node", "own"))).otherwise(
        F.concat_ws("/", F.lit("stray"), _block("component", "strays")))
    split = large.join(held.select("bucket", "component", "own"), ["bucket", "component"]).join(pin(strays), "bucket", "left")
    split = pin(split.select("node", "bucket", block.alias("block"), F.when(F.col("own") > 1, F.col("component")).alias("pure")))
    kinds = split.select("bucket", "block", "pure").distinct()
    meet = kinds.alias("l").join(kinds.alias("r"), "bucket").where(
        "l.block <= r.block and not (l.pure is not null and r.pure is not null and l.pure = r.pure)")
    meet = meet.select("bucket", F.explode(F.array_distinct(F.array("l.block", "r.block"))).alias("block"), F.concat_ws("+", "bucket", "l.block", "r.block").alias("bundle"))
    return placed.unionByName(split.join(meet, ["bucket", "block"]).select("bundle", F.col("bucket").alias("part"), "node"))


def confirmed_links(candidates: DataFrame, sketch: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links whose components are those of all pairs that share a bucket or a small family and are similar enough.

    ``candidates`` (a, b) are links of which the components are the families; ``sketch`` is that of ``docs``.
    """
    families = components(candidates).withColumnRenamed("component", "family")
    # Look-ups are stored: a join to the aggregate itself could not be split where a family or a set is hot.
    sizes = sketch.where("doc_id is not null").select(F.col("doc_id").alias("node"), "n_bytes")
    sized = pin(families.join(sizes, "node").groupBy("node", "family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_bytes").alias("n_bytes")))
    extents = sized.groupBy("family").agg(F.sum("rows").alias("n"), F.sum("n_bytes").alias("size"))
    extents = pin(extents.withColumn("blocks", _blocks("n", "size")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The only join with all texts; later steps read the texts of families alone. The members grow
    # with the documents, so they are never broadcast.
    counted = sized.join(extents.select("family", "blocks", F.col("n").alias("members")), "family")
    held = pin(counted.hint("merge").join(texts, F.col("node") == F.col("doc_id")).drop("node", "rows"))
    # Small families go together in bundles of about a block; of a large one each block is a bundle.
    small, large = held.where("blocks = 1"), held.where("blocks > 1")
    bundle = _bundled(extents.where("blocks = 1"), "family")
    placed = small.select(bundle.cast("string").alias("bundle"), F.col("family").alias("part"), "doc_id", "text")
    if extents.where("blocks > 1").isEmpty():
        return _confirmed(placed, size, percent)
    nodes = large.select("doc_id", "n_bytes", "members", "blocks").distinct()
    # About so many members, by hash: no family is sorted.
    anchors = nodes.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("members")) < ANCHORS)
    anchors = anchors.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    first = large.select("doc_id", "family", _block("doc_id", "blocks").alias("block"), "text").unionByName(
        large.join(anchors, "doc_id").select("doc_id", "family", "block", "text"))
    placed = placed.unionByName(first.select(F.concat_ws("/", "family", "block").alias("bundle"), F.col("family").alias("part"), "doc_id", "text"))
    links = pin(_confirmed(placed, size, percent))
    # Large families: the buckets that still fall apart are compared by themselves.
    found = components(links).withColumnRenamed("node", "doc_id")
    nodes = pin(nodes.join(found, "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("component", "doc_id").alias("component")))
    shared = nodes.join(sketch.select("doc_id", F.explode("bands").alias("bucket")).distinct(), "doc_id").withColumnRenamed("doc_id", "node")
    shared = pin(shared)
    second = second_pass(shared, pin(open_buckets(shared)))
    second = large.select("doc_id", "text").join(second, F.col("doc_id") == F.col("node")).select("bundle", "part", "doc_id", "text")
    return links.unionByName(_confirmed(second, size, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs`` (doc_id, text).

    Two documents are linked if 100 times their common shingles are at least ``percent`` times all
    their shingles; ``component_id`` is the smallest id that links reach. Words are compared with
    A-Z lower-cased. A text with fewer than ``size`` words is one shingle; null, empty and blank
    texts have none and stay alone. A null id is its own, null, component and is kept. Texts may be of any length: one
    is hashed in one piece, and compared in blocks of texts. Other columns of ``docs``, whatever their names, are left out.
    """
    sketch = pin(sketches(docs, size))
    key = ["mark", "check", "n_shingles"]
    held = sketch.where("n_shingles > 0 and doc_id is not null").drop("n_bytes")
    classes = pin(held.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    # Rows that repeat an id are versions of one document, so an id may stand for several classes.
    versions = held.join(classes, key).select(F.col("doc_id").alias("b"), F.col("rep").alias("a")).where("a < b").distinct()
    members = held.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(
        F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket")).distinct()
    centres = members.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    candidates = members.join(centres, "bucket").where("centre < rep").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed_links(candidates, sketch, docs, size, percent).unionByName(versions)
    found = components(links)
    return (
        sketch.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document with the smallest id.

    Of rows that repeat an id the one with the smallest text stays. Rows without an id all stay.
    """
    found = near_duplicates(docs, size, percent)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    repeated = pin(repeated)
    # Neither list has a bound, so neither is broadcast.
    kept = docs.join(gone.hint("merge"), F.col("doc_id") == F.col("gone"), "left_anti")
    if repeated.isEmpty():
        return kept
    rest = kept.join(repeated.hint("merge"), F.col("doc_id") == F.col("again"), "left_anti")
    order = Window.partitionBy("doc_id").orderBy("text")
    again = kept.join(repeated.hint("merge"), F.col("doc_id") == F.col("again"), "left_semi")
    again = again.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return rest.unionByName(again)
