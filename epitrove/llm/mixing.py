"""Interleave sources by target weights: Pfair scheduling of blocks, with SQL functions on the data.

A block is ``block_rows`` documents of one source. The k-th block of a source with weight w is
released at slot floor((k - 1) / w) and due at slot ceil(k / w). In each slot the earliest due of the
released blocks goes next. With weights that add up to one, every source has at each slot less than
one block more or less than its weight asks for.

Weights are taken exactly, as whole parts of their common denominator, so the schedule repeats after
as many slots as there are parts. When a source has no block left the others go on by their weights:
a new phase, with the same bound from its start on. Only the schedule is worked out in the driver, one
line per phase and slot of its cycle, or of the phase if that is shorter. The documents get their
numbers by prefix sums, and their slots by a look-up in the schedule.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F

from epitrove.llm.ordering import running

BLOCK_ROWS = 32
OTHERS = "other sources"


def parts_of(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole parts in exactly the proportion of the weights, each read as the decimal it is written as."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("every source needs a weight above 0")
    exact = {name: Fraction(str(w)) for name, w in weights.items()}
    whole = math.lcm(*[w.denominator for w in exact.values()])
    parts = {name: int(w * whole) for name, w in exact.items()}
    common = math.gcd(*parts.values())
    return {name: p // common for name, p in parts.items()}


def schedule(parts: Mapping[str, int], most: int | None = None) -> list[str]:
    """The source of each slot of one cycle of ``sum(parts)`` slots, or of its first ``most``: earliest deadline first among the released."""
    slots = sum(parts.values())
    # The next block of each source; the one after it is released no sooner than this one is taken.
    waiting = [(0, -(-slots // p), name, 1) for name, p in parts.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots if most is None else min(slots, most)):
        while waiting and waiting[0][0] <= slot:
            _, deadline, name, n = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, name, n))
        deadline, name, n = heapq.heappop(ready)
        assert deadline > slot, "weights of one always meet their deadlines"
        out.append(name)
        heapq.heappush(waiting, (n * slots // parts[name], -(-(n + 1) * slots // parts[name]), name, n + 1))
    return out


def phases(parts: Mapping[str, int], blocks: Mapping[str, int]) -> list[dict]:
    """Rows of the schedule: phase, source, its block in the cycle, that block's slot, and where the phase begins."""
    left = {name: blocks.get(name, 0) for name in parts if blocks.get(name, 0)}
    done = dict.fromkeys(left, 0)
    base, out = 0, []
    while left:
        active = {name: parts[name] for name in left}
        common = math.gcd(*active.values())
        active = {name: p // common for name, p in active.items()}
        # A phase has at most as many slots as blocks, and one in which a source has none.
        order = schedule(active, sum(left.values()) + 1)
        whole = sum(active.values())
        places: dict[str, list[int]] = {name: [] for name in active}
        for slot, name in enumerate(order):
            places[name].append(slot)
        # It ends at the first slot for which a source has no block.
        end = min(n // active[name] * whole + places[name][n % active[name]] for name, n in left.items() if n % active[name] < len(places[name]))
        cycles, rest = divmod(end, whole)
        taken = {name: cycles * active[name] + sum(p < rest for p in places[name]) for name in active}
        for name, slots in places.items():
            out += [{"source": name, "first": done[name], "last": done[name] + taken[name], "parts": active[name], "cycle": whole,
                     "base": base, "turn": n, "slot": slot} for n, slot in enumerate(slots) if cycles or slot < end]
        for name, n in taken.items():
            done[name] += n
            left[name] -= n
        left = {name: n for name, n in left.items() if n}
        base += end
    return out


def _values(spark, rows: list[dict]) -> DataFrame:
    """The schedule as a table that Spark holds itself; names travel as literals."""
    if not rows:
        rows = [{"source": "", "first": 0, "last": 0, "parts": 1, "cycle": 1, "base": 0, "turn": 0, "slot": 0}]
    keys = ["first", "last", "parts", "cycle", "base", "turn", "slot"]
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lines = ", ".join("(" + quoted(r["source"]) + ", " + ", ".join(f"{r[k]}L" for k in keys) + ")" for r in rows)
    return spark.sql("SELECT * FROM VALUES " + lines + " AS t(mix_source, " + ", ".join(f"mix_{k}" for k in keys) + ")")


def mix(docs: DataFrame, weights: Mapping[str, float], other_weight: float = 1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, …), each once, with ``mix_source``, ``mix_block``, ``mix_slot`` and ``mix_position``.

    ``mix_position`` is the row's place in the mix, without gaps from 0. A source's rows come in the
    order of doc_id. Sources without a weight, and null, share ``other_weight`` as one more source.
    Sources without rows are left out. A null id comes first; rows that repeat an id follow each
    other. Columns of these names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    if OTHERS in weights:
        raise ValueError(f"{OTHERS} is the name for all other sources")
    parts = parts_of({**weights, OTHERS: other_weight})
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_position")
    source = F.col("source").cast("string")
    named = docs.withColumn("mix_source", F.when(source.isin(list(weights)), source).otherwise(OTHERS))
    # At most as many rows as there are weights, and one.
    counts = {r["mix_source"]: r["n"] for r in named.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {name: -(-n // block_rows) for name, n in counts.items()}
    rows = phases(parts, blocks)
    plan = F.broadcast(_values(spark, rows))
    numbered = running(named, ["doc_id"], {"mix_number": F.lit(1).cast("long")}, within="mix_source")
    numbered = numbered.withColumn("mix_block", F.expr(f"mix_number div {block_rows}")).alias("d")
    placed = numbered.join(plan.alias("p"), F.expr(
        "d.mix_source = p.mix_source and d.mix_block >= p.mix_first and d.mix_block < p.mix_last and (d.mix_block - p.mix_first) % p.mix_parts = p.mix_turn"))
    slot = F.expr("p.mix_base + (d.mix_block - p.mix_first) div p.mix_parts * p.mix_cycle + p.mix_slot")
    # The last block of a source may be short; what follows it moves up.
    ends = sorted((slot_of(rows, name, n - 1), n * block_rows - counts[name]) for name, n in blocks.items())
    short = F.lit(0).cast("long")
    for at, missing in ends:
        if missing:
            short = short + F.when(F.col("mix_slot") > at, missing).otherwise(0)
    return placed.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("d.mix_source"), F.col("mix_block"), slot.alias("mix_slot"), F.col("mix_number")).withColumn(
        "mix_position", F.col("mix_slot") * block_rows + F.col("mix_number") % block_rows - short).drop("mix_number")


def with_places(rows: DataFrame, docs: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``rows`` (doc_id, source, …) and the ``mix_place`` that the mix of ``docs`` gives each one's document.

    Places are worked out on ids and sources alone. Rows that repeat an id and a source share a place;
    rows without an id have none.
    """
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    places = mix(key.where("doc_id is not null").distinct(), weights).select(
        F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_of"), F.col("mix_position").alias("mix_place"))
    # Both sides grow with the documents, so neither is broadcast.
    match = (F.col("doc_id") == F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_of"))
    return rows.join(places.hint("merge"), match, "left").select(*[F.col(f"`{c}`") for c in rows.columns], "mix_place")


def in_mix_order(docs: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """The rows of ``docs`` sorted by their place in the mix; rows without an id come after the mix.

    The order is that of the rows as they are returned. A table written from them and read again has another one.
    """
    placed = with_places(docs, docs, weights)
    return placed.orderBy(F.asc_nulls_last("mix_place")).select(*[F.col(f"`{c}`") for c in docs.columns])


def slot_of(rows: list[dict], source: str, block: int) -> int:
    """The slot of one block of a source."""
    for r in rows:
        if r["source"] == source and r["first"] <= block < r["last"] and (block - r["first"]) % r["parts"] == r["turn"]:
            return r["base"] + (block - r["first"]) // r["parts"] * r["cycle"] + r["slot"]
    raise KeyError((source, block))
