"""Pack tokenized documents into sequences of fixed length: bounded-space online best-fit.

Each document is tokenized once, where it is read; only the lengths of its pieces are moved. Pieces
are packed in the order in which the documents were read, or in the order of a place that is looked
up for their documents, in groups of some ten thousand pieces. A
group keeps at most ``open_bins`` sequences open. The open ones are found through a bitset with one
bit for each amount of free space: the lowest bit at or above a piece's length is the best fit. If
nothing fits and all are open, the fullest is closed.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epitrove.llm.ordering import running
from epitrove.plans.storage import pin

GROUP_PIECES = 20_000
OPEN_BINS = 256
KNOWN_WORDS = 200_000
"""Words of which a worker remembers the ids; when there are more it starts anew."""


def _byte_names() -> dict[str, int]:
    """The character by which byte-level vocabularies name each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [n for n in range(256) if n not in printable]
    return {chr(n): n for n in printable} | {chr(256 + k): n for k, n in enumerate(others)}


class Encoder:
    """Ids of texts, as bytes of little-endian 32-bit numbers, as the tokenizer in a file gives them.

    A byte-level vocabulary cuts a text before every space that stands between a character that is
    no white space and one that is, so words have the same ids wherever they stand. Words seen before
    are looked up. New ones are strung together and encoded by ``tiktoken`` with the ranks of the
    same file, which does the same merges faster. All else goes through ``tokenizers``: words that
    begin or end with white space or hold a special token, texts with a space between two other white
    spaces, and every text if the file is not a plain byte-level one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.odd = re.compile(r"\s (?:\s|\Z)").search
        file = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in file["added_tokens"]]
        split = file["pre_tokenizer"] or {}
        vocabulary = file["model"].get("vocab")
        self.plain = (file["model"]["type"] == "BPE" and file["normalizer"] is None and split.get("type") == "ByteLevel"
                      and not split["add_prefix_space"] and split["use_regex"] and not file["model"]["ignore_merges"])
        if self.plain:
            names = _byte_names()
            ranks = {bytes(names[c] for c in token): n for token, n in vocabulary.items() if token not in self.special}
            merged = [vocabulary["".join(pair)] for pair in file["model"]["merges"]]
            self.plain = merged == sorted(merged)
        if self.plain:
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.spaced = np.zeros(max(ranks.values()) + 1, bool)
            self.spaced[[n for token, n in ranks.items() if token[:1] == b" "]] = True

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        easy = [w for w in words if w and not w[0].isspace() and not w[-1].isspace() and not any(s in w for s in self.special)]
        hard = list({*words}.difference(easy))
        self.known.update(zip(hard, self._slow([" " + w for w in hard])))
        if easy:
            ids = np.frombuffer(self.fast.encode_to_numpy(" " + " ".join(easy), disallowed_special=()), np.uint32)
            bounds = 4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            packed, edges = ids.astype("<u4").tobytes(), bounds.tolist()
            self.known.update(zip(easy, [packed[s:e] for s, e in zip(edges, edges[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._slow(texts)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        parts = [None if self.odd(text) else text.split(" ") for text in texts]
        words: set[str] = set()
        for part in parts:
            if part:
                words.update(part[1:])
        self._learn([w for w in words if w not in known])
        heads = iter(self._slow([p[0] for p in parts if p]))
        wholes = iter(self._slow([t for t, p in zip(texts, parts) if not p]))
        return [next(heads) + b"".join([known[w] for w in p[1:]]) if p else next(wholes) for p in parts]


_encoders: dict[str, Encoder] = {}
_SLICE = 256


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: all but the first are full."""
    first = length % most or most
    return [(0, min(first, length))] + [(start, most) for start in range(first, length, most)]


def _pieces(path: str, end_id: int, most: int):
    names = ["part", "doc", "doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    read = ["part", "doc", "doc_id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, Encoder(path))
        ending = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low in range(0, len(batch), _SLICE):
                part = batch.slice(low, _SLICE)
                rows, of = [], []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for row, (place, doc, doc_id, ids) in enumerate(zip(part.column("part").to_pylist(), part.column("doc").to_pylist(),
                                                                    part.column("doc_id").to_pylist(), encoder.encode(texts))):
                    ids += ending
                    rows += [(place, doc, doc_id, n, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))
                             for n, (start, length) in enumerate(cut(len(ids) // 4, most))]
                    of += [row] * (len(rows) - len(of))
                kept = [c for c in part.schema.names if c not in read]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)]
                                                 + [part.column(c).take(pa.array(of, pa.int32())) for c in kept], names=names + kept)

    return run


def best_fit(lengths: list[int], most: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, in the order given."""
    free_bits, by_free, opened, made = 0, {}, 0, 0
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for n, length in enumerate(lengths):
        fitting = free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bins = by_free[free]
            name = bins.pop()
            if not bins:
                del by_free[free]
                free_bits ^= 1 << free
            opened -= 1
        else:
            name, free = made, most
            made += 1
        sequence[n], offset[n] = name, most - free
        left = free - length
        if left:
            if opened == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                if left <= fullest:
                    continue
                bins = by_free[fullest]
                bins.pop(0)
                if not bins:
                    del by_free[fullest]
                    free_bits ^= 1 << fullest
                opened -= 1
            by_free.setdefault(left, []).append(name)
            free_bits |= 1 << left
            opened += 1
    return sequence, offset


def _pack(most: int, open_bins: int, order: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in order])
        sequence, offset = best_fit(table["length"].to_pylist(), most, open_bins)
        first = table["bundle"][0].as_py() << 32 if len(table) else 0
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column(
            "sequence_id", pa.array(sequence, pa.int64()) if not first else pa.array([first + s for s in sequence], pa.int64())
        ).append_column("offset", pa.array(offset, pa.int64()))

    return run


_PIECES = "part int, doc long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _read(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("doc"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Where each piece of each document of ``docs`` (doc_id, text) goes.

    ``tokenizer`` is the path of a byte-level tokenizer's file, the same on all workers. A document is its ids and then
    ``end_id``; one longer than ``most`` is cut into full pieces, of which the first may be shorter.
    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset``. Null texts count as empty and are packed as ``end_id`` alone. Rows that repeat an id
    are packed as often as they come; null ids are packed under null. A text of any length is encoded whole; only its
    pieces are moved. Other columns of ``docs``, whatever their names, are left out.
    """
    pieces = pin(_read(docs).mapInArrow(_pieces(tokenizer, end_id, most), _PIECES))
    # Neighbouring partitions of the input share a group until it has enough pieces.
    count, parts = pieces.agg(F.count(F.lit(1)), F.max("part")).first()
    groups = max(1, min(-(-count // group_pieces), (parts or 0) + 1))
    bundle = (F.col("part") * F.lit(groups).cast("long") / F.lit((parts or 0) + 1)).cast("long")
    return pieces.withColumn("bundle", bundle).groupBy("bundle").applyInArrow(_pack(most, open_bins, ["part", "doc", "piece"]), _PACKED)


def pack_by_place(docs: DataFrame, placed: Callable[[DataFrame], DataFrame], tokenizer: str, most: int = 2048, end_id: int = 0,
                  open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """As ``pack``, in the order of the places of the documents, however ``docs`` (doc_id, source, text) is stored and read.

    ``placed`` is given the pieces, with doc_id and source, and adds their documents' ``place``; null is last.
    Rows that share a place are packed one after the other. Sequences are numbered by groups of
    equally many pieces, so a piece of an earlier group has the smaller ``sequence_id``.
    """
    pieces = _read(docs, F.col("source").cast("string").alias("source")).mapInArrow(_pieces(tokenizer, end_id, most), _PIECES + ", source string")
    pieces = pin(pieces)
    count = pieces.count()
    groups = max(1, -(-count // group_pieces))
    order = ["place", "doc", "piece"]
    last = F.lit((1 << 63) - 1).cast("long")
    numbered = running(placed(pieces).withColumn("place", F.coalesce("place", last)), order, {"number": F.lit(1).cast("long")})
    bundle = F.expr(f"number * {groups}L div {max(1, count)}L")
    return numbered.withColumn("bundle", bundle).groupBy("bundle").applyInArrow(_pack(most, open_bins, order), _PACKED)
