"""Result documents that are too long for one task: all tasks that read a piece cut the tables in it into rows.

A document is read in records that end at a comma, so a split begins behind one and within no escape. What holds there
(in a string or not, how deep, in which table) follows from one row per split that says what the split changes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from epitrove.plans.joins import lookup_join
from epitrove.plans.storage import pin

# Rows of a table stand on the fifth level, in the document, data, results, a result and its table_data.
_ROWS = 5
_TABLE = re.compile(rb'"table_data"\s*:\s*\[')
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_QUOTE, _COMMA = ord('"'), ord(",")
_STEP = np.zeros(256, dtype=np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_SIGN = _STEP != 0
_SIGN[_COMMA] = True

_CHANGES = "file string, split long, quotes long, outside long, inside long"
_TOLD = "file string, split long, opened long, closed boolean, incoming long, first long"
_CUT = "file string, split long, table long, row long, whole boolean, text binary"


def _without_escapes(data: bytes) -> bytes:
    return _ESCAPED.sub(b"__", data) if b"\\" in data else data


def _in_string(plain: np.ndarray, before: bool) -> np.ndarray:
    """Which bytes are inside of a string; an opening quote counts, a closing one doesn't."""
    return np.bitwise_xor.accumulate((plain == _QUOTE).view(np.uint8)).view(bool) ^ before


class _Changes:
    """How many quotes a split has, and how many levels it goes down if it begins outside or inside of a string."""

    def __init__(self, first: dict) -> None:
        self.told = {"file": first["file"], "split": first["split"], "quotes": 0, "outside": 0, "inside": 0}

    def feed(self, data: bytes) -> list[dict]:
        plain = np.frombuffer(_without_escapes(data), dtype=np.uint8)
        steps, inside = _STEP[plain], _in_string(plain, self.told["quotes"] % 2 == 1)
        self.told["quotes"] += int(np.count_nonzero(plain == _QUOTE))
        self.told["outside"] += int(steps[~inside].sum())
        self.told["inside"] += int(steps[inside].sum())
        return []

    def finish(self) -> list[dict]:
        return [self.told]


class _Cut:
    """Cuts a split into rows of tables and the rest, in which ``{"cut": number}`` stands for a table's rows.

    A table's number is the split it begins in plus the tables before it there. A row that began elsewhere or goes on
    in the next split is a piece; pieces, and the rest of each split (without a table), are to be put together.
    """

    def __init__(self, first: dict, keep: str) -> None:
        self.keep, self.file, self.split = keep, first["file"], first["split"]
        self.inside, self.depth = first["in_string"], first["depth"]
        # While only levels are known, any list or object may turn out to be a table's rows.
        self.table = first.get("table", -1) if self.depth >= _ROWS else None
        self.row = first.get("row") or 0
        self.incoming, self.fresh = self.table is not None, self.depth == _ROWS and not self.inside
        self.told = {"file": self.file, "split": self.split, "opened": None, "closed": False, "incoming": 0, "first": 0}
        self.begun, self.held, self.rest = 0, [], []

    def _piece(self, text: bytes, ended: bool) -> list[dict]:
        text, self.held = b"".join([*self.held, text]), []
        whole, self.fresh = ended and self.fresh, True
        if self.keep != ("whole" if whole else "pieces") or (whole and not text.strip()):
            return []
        return [{"file": self.file, "split": self.split, "table": self.table, "row": self.row, "whole": whole, "text": text}]

    def feed(self, data: bytes) -> list[dict]:
        clean = _without_escapes(data)
        plain = np.frombuffer(clean, dtype=np.uint8)
        inside = _in_string(plain, self.inside)
        at = np.flatnonzero(_SIGN[plain] & ~inside)
        steps = _STEP[plain[at]]
        depth = self.depth + np.cumsum(steps, dtype=np.int64)
        # A key and its list have no comma between them, so they are never in two batches.
        tables = {m.end() - 1 for m in _TABLE.finditer(clean)}
        border = np.where(steps < 0, depth == _ROWS - 1, depth == _ROWS)
        found, last = [], 0
        for place, step in zip(at[border].tolist(), steps[border].tolist()):
            if self.table is None:
                if step == 1 and place in tables:
                    self.table, self.row, self.fresh, self.incoming = self.split + self.begun, 0, True, False
                    self.begun += 1
                    self.rest += [data[last:place + 1], b'{"cut":%d}' % self.table]
                    last = place + 1
                continue
            found += self._piece(data[last:place], True)
            if step == 0:
                self.row, last = self.row + 1, place + 1
            else:
                self.told["closed"] |= self.incoming
                self.table, last, self.incoming = None, place, False
        (self.rest if self.table is None else self.held).append(data[last:])
        if self.keep == "tables":
            self.rest, self.held = [], []
        self.inside = bool(inside[-1])
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return found

    def finish(self) -> list[dict]:
        if self.keep == "tables":
            if self.incoming:
                self.told["incoming"] = self.row
            elif self.table is not None:
                self.told |= {"opened": self.table, "first": self.row}
            return [self.told]
        found = self._piece(b"", False) if any(self.held) else []
        if self.keep == "pieces" and any(self.rest):
            found.append({"file": self.file, "split": self.split, "table": None, "row": 0, "whole": False, "text": b"".join(self.rest)})
        return found


def _by_split(batches: Iterator[pa.RecordBatch], begin, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Hand the bytes of each split to what ``begin`` makes of its first record."""
    current, work = None, None
    for batch in batches:
        ends = {n for name in ("file", "split") for n in pc.run_end_encode(batch.column(name)).run_ends.to_pylist()}
        found, start = [], 0
        for end in sorted(ends):
            first = batch.slice(start, 1).to_pylist()[0]
            if (first["file"], first["split"]) != current:
                found += work.finish() if work else []
                current, work = (first["file"], first["split"]), begin(first)
            found += work.feed(b",".join(batch.column("value").slice(start, end - start).to_pylist()) + b",")
            start = end
        yield _batch(found, names)
    yield _batch(work.finish() if work else [], names)


_KINDS = {"file": pa.string(), "text": pa.binary(), "closed": pa.bool_(), "whole": pa.bool_()}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS.get(n, pa.int64())) for n in names], names)


def _mapped(records: DataFrame, begin, schema: str) -> DataFrame:
    names = [field.split(" ")[0] for field in schema.split(", ")]
    return records.mapInArrow(functools.partial(_by_split, begin=begin, names=names), schema)


def cut_long_documents(spark: SparkSession, path: str, longer_than: int) -> tuple[DataFrame, DataFrame] | None:
    """Of the files of more than ``longer_than`` bytes below ``path``: ``file``, ``value``, the document with ``{"cut": table}``
    for the rows of each table, and ``file``, ``table``, ``row``, ``text``, the rows. None if there is no such file.

    The rest of a document is put together as one text, and so is each row.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    records = spark.read.text(path, lineSep=",").where(F.col("_metadata.file_size") > longer_than).select(*place, F.col("value").cast("binary").alias("value"))
    if records.isEmpty():
        return None
    # All tables that are broadcast have one row per split, as Spark's own list of splits has.
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changes = pin(_mapped(records, _Changes, _CHANGES)).withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    levels = pin(changes.select("file", "split", "in_string", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth")))

    def cut(states: DataFrame, keep: str, schema: str = _CUT) -> DataFrame:
        return _mapped(records.join(F.broadcast(states), ["file", "split"]), functools.partial(_Cut, keep=keep), schema)

    told = pin(cut(levels, "tables", _TOLD))
    # The rows of a table before a split: those in the split it began in, and those of each split since.
    opened = F.struct(F.col("opened").alias("table"), (F.col("first") - F.sum("incoming").over(so_far)).alias("row"))
    closed = F.struct(F.lit(None).cast("long").alias("table"), F.lit(0).cast("long").alias("row"))
    event = F.when(F.col("opened").isNotNull(), opened).when(F.col("closed"), closed)
    latest = told.withColumn("event", event).select(
        "file", "split", F.last("event", True).over(before).alias("event"), F.coalesce(F.sum("incoming").over(before), F.lit(0)).alias("since"))
    states = pin(lookup_join(levels, latest, ["file", "split"], "inner").select(
        "file", "split", "in_string", "depth", F.col("event.table").alias("table"), (F.col("event.row") + F.col("since")).alias("row")))

    text = F.col("text").cast("string").alias("text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("split", text))), lambda p: p["text"])
    joined = pin(cut(states, "pieces").groupBy("file", "table", "row").agg(F.array_join(ordered, "").alias("text")))
    # The last record of a file has no comma behind it.
    rests = joined.where("table IS NULL").select("file", F.regexp_replace("text", r",\z", "").alias("value"))
    rows = cut(states, "whole").select("file", "table", "row", text).unionByName(joined.where("table IS NOT NULL").select("file", "table", "row", "text"))
    return rests, rows
