"""For every position the best of the intervals over it, without a row per interval and position.

Positions are cut into blocks; an interval goes to the blocks it meets, as a piece in each. In a
block of positions a piece is the union of two stretches whose length is a power of two. Each
stretch keeps its best piece and hands it down to its two halves, until single positions are left.
All blocks of a batch are worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

BLOCK = 64
_NONE = np.iinfo(np.int64).max


def best_over_positions(block: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, blocks: int, size: int = BLOCK) -> np.ndarray:
    """The least rank over each of ``size`` positions of each block, of pieces from ``low`` to ``high``; a large number where there is none."""
    level = np.frexp(high - low + 1)[1] - 1
    best, top = np.full((blocks, size), _NONE), int(level.max(initial=0))
    cells = best.reshape(-1)
    for k in range(top, -1, -1):
        if k < top:
            # A stretch of twice this length hands down to its first half in place, and to its second.
            half = 1 << k
            best[:, half:] = np.minimum(best[:, half:], best[:, :-half].copy())
        held = level == k
        np.minimum.at(cells, block[held] * size + low[held], rank[held])
        np.minimum.at(cells, block[held] * size + high[held] - (1 << k) + 1, rank[held])
    return best


def _sweep(slices: list[str], order: list[str]):
    def solved(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        place = np.cumsum(new) - 1
        rank = np.empty(len(rows), np.int64)
        ordered = np.asarray(pc.sort_indices(rows, [(name, "ascending") for name in order]))
        rank[ordered] = np.arange(len(rows))
        base = np.asarray(rows["block"], dtype=np.int64) * BLOCK
        low = np.maximum(np.asarray(rows["start"], dtype=np.int64) - base, 0)
        high = np.minimum(np.asarray(rows["end"], dtype=np.int64) - base, BLOCK - 1)
        best = best_over_positions(place, low, high, rank, int(place[-1]) + 1)
        block, position = np.nonzero(best != _NONE)
        chosen = ordered[best[block, position]]
        table = rows.take(pa.array(chosen)).append_column("position", pa.array(base[chosen] + position, pa.int32()))
        return table.select([*slices, "position", *order]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            new = _changes(rows, slices)
            last = int(np.flatnonzero(new)[-1])
            # The last block may go on in the next batch.
            held = rows.slice(last)
            if last:
                yield solved(rows.slice(0, last).combine_chunks(), new[:last])
        if held is not None:
            yield solved(held.combine_chunks(), _changes(held, slices))

    return run


def _changes(rows: pa.Table, slices: list[str]) -> np.ndarray:
    """Which rows are the first of their slice and block."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for name in [*slices, "block"]:
        codes = np.asarray(pc.rank(rows[name], tiebreaker="dense"))
        new[1:] |= codes[1:] != codes[:-1]
    return new


def best_interval(rows: DataFrame, slices: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``slices``, ``position`` and ``order`` of the first interval by ``order`` over every covered position.

    ``rows`` has integer columns ``start`` and ``end`` (both inclusive, start not after end) and no nulls in
    ``order``. A slice with very many intervals is spread by its blocks.
    """
    slices, order = list(slices), list(order)
    needed = list(dict.fromkeys([*slices, "start", "end", *order]))
    pieces = rows.select(*needed, F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK))).alias("block"))
    sorted_pieces = pieces.repartition(*slices, "block").sortWithinPartitions(*slices, "block")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in slices] + [T.StructField("position", T.IntegerType())] + [T.StructField(n, kinds[n]) for n in order])
    return sorted_pieces.mapInArrow(_sweep(slices, order), schema)
