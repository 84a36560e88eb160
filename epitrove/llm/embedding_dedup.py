"""Near-duplicate vectors by an inverted multi-index.

Each half of a unit vector has a codebook of its own; a cell of the index is a pair of codes. A vector visits
cells in the order of the sum of its halves' distances (the multi-sequence order) and meets the
vectors at home there. The first n cells of that order lie under the hyperbola (i + 1) * (j + 1) <= n
of the sorted halves, so they are found without the whole grid. How many are visited follows from a
sample: ``QUERIES`` vectors are compared with all rows, and as many cells are visited as it takes to
find ``RECALL`` of their links from one side or the other, and ``RECALL`` of ``TURNED`` links of just the
threshold's cosine, however few links the sample has. Cosines are then taken in double precision.

The codebooks are fitted on at most ``SAMPLE`` vectors; all vectors are indexed. Equal vectors are
one entry with a count. A cell's members and visitors meet in blocks of at most ``BLOCK`` each, so
a cell that holds a third of all vectors is many tasks. A block returns counts and a forest, no pairs.

Vectors of each length are compared with each other: lengths with more than ``BLOCK`` different vectors have
an index of their own, those of any rarer length are one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from epitrove.llm.components import components
from epitrove.llm.folds import below_share, sample_order
from epitrove.plans.storage import pin

SAMPLE, QUERIES, LINKS_OF_A_QUERY = 16_384, 1_024, 32
CELL_VECTORS, MOST_CODES = 128, SAMPLE // 4
BLOCK = 2_048
RECALL, LEAST_VISITS, TURNED = 0.99, 4, 1_024


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, safe for very large and very small components."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _squares(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ codes.T + (codes * codes).sum(axis=1)[None, :]


def codebook(rows: np.ndarray, count: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of a k-means over rows."""
    random = np.random.default_rng(seed)
    centres = rows[random.choice(len(rows), count, replace=False)].copy()
    for _ in range(rounds):
        own = _squares(rows, centres).argmin(axis=1)
        sizes = np.bincount(own, minlength=count)
        sums = np.stack([np.bincount(own, rows[:, n], minlength=count) for n in range(rows.shape[1])], axis=1)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


class Index:
    """Two codebooks; ``visits`` gives the cells nearest to each unit vector, its home first."""

    def __init__(self, sample: np.ndarray, codes: int) -> None:
        codes = min(codes, len(sample))
        self.half = sample.shape[1] // 2
        self.books = [codebook(sample[:, :self.half], codes), codebook(sample[:, self.half:], codes)]
        self.codes = codes

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(rows[:, :self.half], self.books[0]), _squares(rows[:, self.half:], self.books[1])

    def visits(self, rows: np.ndarray, count: int) -> np.ndarray:
        count = min(count, self.codes**2)
        left, right = np.divmod(np.arange(min(count, self.codes) ** 2), min(count, self.codes))
        under = (left + 1) * (right + 1) <= count
        left, right = left[under], right[under]
        ones, twos = self.distances(rows)
        first, second = ones.argsort(axis=1, kind="stable"), twos.argsort(axis=1, kind="stable")
        sums = np.take_along_axis(ones, first, 1)[:, left] + np.take_along_axis(twos, second, 1)[:, right]
        nearest = sums.argsort(axis=1, kind="stable")[:, :count]
        return np.take_along_axis(first, left[nearest], 1) * self.codes + np.take_along_axis(second, right[nearest], 1)

    def rank(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells each row visits before the given one."""
        out = np.empty(len(rows), np.int64)
        for n, (one, two, cell) in enumerate(zip(*self.distances(rows), cells)):
            limit = one[cell // self.codes] + two[cell % self.codes]
            out[n] = (one[:, None] + two[None, :] < limit).sum()
        return out


def turned(rows: np.ndarray, cosine: float, seed: int = 2) -> np.ndarray:
    """Unit vectors at the given cosine from each unit vector, in random directions."""
    aside = np.random.default_rng(seed).normal(size=rows.shape)
    aside -= (aside * rows).sum(axis=1, keepdims=True) * rows
    return cosine * rows + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)


def _links_of(queries: np.ndarray, names: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nodes = _matrix(batch.column("vector")), batch.column("node").to_numpy()
            for start in range(0, len(rows), 4096):
                near = unit(rows[start:start + 4096]) @ queries.T >= threshold
                near &= nodes[start:start + 4096, None] != names[None, :]
                row, query = np.nonzero(near)
                # No more of a query than are wanted in the end.
                order = np.argsort(query, kind="stable")
                row, query = row[order], query[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                row, query = row[place < LINKS_OF_A_QUERY], query[place < LINKS_OF_A_QUERY]
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), batch.column("node").take(pa.array(row + start)),
                                                  batch.column("vector").take(pa.array(row + start))], names=["query", "node", "vector"])

    return run


def _visited(index: Index, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(64, min(4096, 262_144 // count))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                cells = index.visits(unit(_matrix(part.column("vector"))), count).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[:, 0]), lists], names=[*part.schema.names, "home", "cells"])

    return run


def _meet(threshold: float):
    """Links between the members of a cell and its visitors, each direction of a link counted in one cell only.

    Members bring the cells that they visit, visitors their home.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        rows, member = unit(_matrix(table["vector"])) if len(table) else np.zeros((0, 1)), table["member"].to_numpy(zero_copy_only=False)
        here = np.flatnonzero(member)
        guests = np.flatnonzero(~member)
        if not len(here) or not len(guests):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        linked = rows[guests] @ rows[here].T >= threshold
        linked &= nodes[guests][:, None] != nodes[here][None, :]
        to_guests = linked @ copies[here]
        to_here = np.zeros(len(here), np.int64)
        homes, cells = table["home"].to_numpy()[guests], _matrix(table["cells"].filter(table["member"]))
        some = np.flatnonzero(linked.any(axis=1))
        for home in np.unique(homes[some]):
            # A member that visits the guest's home counts the link there.
            misses = ~(cells == home).any(axis=1)
            if misses.any():
                own = some[homes[some] == home]
                to_here += misses * (copies[guests[own]] @ linked[own])
        labels_here, labels_guests = nodes[here], nodes[guests]
        most = np.iinfo(np.int64).max
        while True:
            new_guests = np.minimum(labels_guests, np.where(linked, labels_here[None, :], most).min(axis=1))
            new_here = np.minimum(labels_here, np.where(linked, new_guests[:, None], most).min(axis=0))
            if (new_guests == labels_guests).all() and (new_here == labels_here).all():
                break
            labels_guests, labels_here = new_guests, new_here
        node = np.concatenate([nodes[guests], nodes[here]])
        links = np.concatenate([to_guests, to_here])
        near = np.concatenate([labels_guests, labels_here])
        kept = (links > 0) | (near != node)
        return pa.table({"node": pa.array(node[kept], pa.int64()), "links": pa.array(links[kept], pa.int64()), "near": pa.array(near[kept], pa.int64())})

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row of ``vectors`` (vec_id, embedding).

    A link is a cosine of at least ``threshold`` between vectors of one length. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id that links reach. Vectors that are null or zero or hold null,
    NaN or infinite components have no links. A null id never is a component's id unless the component has no other;
    such a row is kept. Rows that repeat an id or a vector are answered one by one; other columns are left out.
    """
    kind = next(f.dataType for f in vectors.schema.fields if f.name.lower() == "embedding")
    number = T.FloatType() if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else T.DoubleType()
    rows = pin(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                              F.col("embedding").cast(T.ArrayType(number)).alias("vector")))
    usable = rows.where(_usable(F.col("vector")))
    classes = pin(usable.groupBy("vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
                  .withColumn("length", F.size("vector")))
    lengths = pin(classes.groupBy("length").agg(F.count(F.lit(1)).alias("n")))
    vector_type = f"array<{number.simpleString()}>"
    common = [r["length"] for r in lengths.where(F.col("n") > BLOCK).collect()]
    met = [_met_in_cells(classes.where(F.col("length") == length), vector_type, threshold, recall) for length in common]
    rare = classes.where(~F.col("length").isin(common)) if common else classes
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("member")
    nowhere = F.lit(0).alias("home"), F.array(F.lit(0)).alias("cells")
    met.append(rare.select("length", "node", "copies", "vector", *nowhere, sides).groupBy("length").applyInArrow(_meet(threshold), _MET))
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    met = pin(found)

    # Vectors with many copies are one row until the end; look-ups by a node or component are stored, so that a hot one is split.
    counts = pin(met.groupBy("node").agg(F.sum("links").alias("links")))
    reached = components(met.where("near <> node").select(F.col("near").alias("a"), F.col("node").alias("b")))
    of = classes.join(counts, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = pin(of.select("vector", "component", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    ids = pin(of.groupBy("component").agg(F.min("least_id").alias("component_id")))
    of = pin(of.join(ids, "component").select("vector", "n_links", "component_id"))
    return rows.join(of, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


_MET = "node long, links long, near long"


def _met_in_cells(classes: DataFrame, vector_type: str, threshold: float, recall: float) -> DataFrame:
    """``node``, ``links``, ``near`` from the cells of an index over ``classes`` (node, copies, vector), all of one length."""
    count = classes.count()
    few = classes.select("node", "vector").where(below_share("node", SAMPLE, F.lit(count)))
    sample = few.orderBy(sample_order("node"), "node").limit(SAMPLE).toArrow()
    known = unit(_matrix(sample["vector"]))
    codes = int(np.clip(np.sqrt(count / CELL_VECTORS), 1, MOST_CODES))
    index = Index(known, codes)
    queries, names = known[:QUERIES], sample["node"].to_numpy()[:QUERIES]
    near = classes.mapInArrow(_links_of(queries, names, threshold), f"query int, node long, vector {vector_type}")
    first = Window.partitionBy("query").orderBy(F.xxhash64("node"), "node")
    near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= LINKS_OF_A_QUERY).select("query", "vector").toArrow()
    visits = LEAST_VISITS
    pairs = []
    if len(near):
        pairs.append((queries[near["query"].to_numpy()], unit(_matrix(near["vector"]))))
    if known.shape[1] > 1 and abs(threshold) < 1:
        ours = np.resize(queries, (TURNED, known.shape[1]))
        pairs.append((ours, turned(ours, threshold)))
    for ours, theirs in pairs:
        ranks = np.minimum(index.rank(ours, index.visits(theirs, 1)[:, 0]), index.rank(theirs, index.visits(ours, 1)[:, 0]))
        visits = max(visits, int(np.ceil(np.quantile(ranks, recall))) + 1)

    placed = pin(classes.select("node", "copies", "vector").mapInArrow(_visited(index, visits), f"node long, copies long, vector {vector_type}, home int, cells array<int>"))
    homes = placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("members"))
    guests = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("guests"))
    # Two numbers a cell; stored, so that Spark knows its size, and can split a cell that very many visit.
    blocks = pin(homes.join(guests, "cell").select("cell", F.ceil(F.col("members") / BLOCK).alias("member_blocks"), F.ceil(F.col("guests") / BLOCK).alias("guest_blocks")))
    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    mine = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    members = placed.withColumn("cell", F.col("home")).join(blocks, "cell").select(
        "cell", mine("member_blocks").alias("member_block"), upto("guest_blocks").alias("guest_block"), "node", "copies", "vector", "home", "cells", F.lit(True).alias("member"))
    visitors = placed.select("node", "copies", "vector", "home", F.explode("cells").alias("cell")).join(blocks, "cell").select(
        "cell", upto("member_blocks").alias("member_block"), mine("guest_blocks").alias("guest_block"), "node", "copies", "vector", "home",
        F.lit(None).cast("array<int>").alias("cells"), F.lit(False).alias("member"))
    return pin(members.unionByName(visitors).groupBy("cell", "member_block", "guest_block").applyInArrow(_meet(threshold), _MET))
