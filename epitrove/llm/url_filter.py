"""Allow and block rules for hosts and path beginnings, by a sort-merge range join.

A host's labels in reverse order, each with a dot after it, make a key for which a host and its
subdomains are one range: they begin with the host's own key. Pages are dealt to ranges of that
key; a rule goes to each range that its own interval meets, so the rules above a range come along.
In a range both sides are sorted and swept together: a stack holds the hosts with rules that enclose the
current one. For each page host the path beginnings on the stack are swept against its sorted paths
with a second stack, whose entries are each the beginning of the next.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RANGE_ROWS = 50_000
SAMPLE = 20_000
"""Keys that bounds are taken from; with more ranges than that, each stretch of keys is dealt to several ranges by id."""
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), *_LETTERS)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``a.example.com`` as ``com.example.a.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Paths:
    """Sweeps ascending paths over path beginnings; a stack holds those that the current path begins with."""

    def __init__(self, rules: list[tuple[bytes, tuple]]) -> None:
        self.rules, self.next, self.stack = sorted(rules, key=lambda r: r[0]), 0, []

    def best(self, path: bytes) -> tuple | None:
        while self.stack and not path.startswith(self.stack[-1][0]):
            self.stack.pop()
        while self.next < len(self.rules) and self.rules[self.next][0] <= path:
            start, rule = self.rules[self.next]
            self.next += 1
            if path.startswith(start):
                # Of all rules that fit, the best one so far stays on top.
                best = max(rule, self.stack[-1][1]) if self.stack else rule
                self.stack.append((start, best))
        return self.stack[-1][1] if self.stack else None


def sweep(pages: list[tuple[bytes, bytes]], rules: list[tuple[bytes, bytes, tuple]]) -> list[tuple | None]:
    """For each page (key, path), sorted, the largest rule (key, path, rule) that fits it."""
    rules = sorted(rules, key=lambda r: r[:2])
    out, stack, place, host, paths = [], [], 0, None, None
    for key, path in pages:
        if key != host:
            host = key
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            while place < len(rules) and rules[place][0] <= key:
                start = rules[place][0]
                end = bisect_right(rules, start, lo=place, key=lambda r: r[0])
                if key.startswith(start):
                    stack.append((start, [(r[1], r[2]) for r in rules[place:end]]))
                place = end
            paths = _Paths([r for _, frame in stack for r in frame])
        out.append(paths.best(path))
    return out


def _join(pages: pa.Table, rules: pa.Table) -> pa.Table:
    pages = pages.sort_by([("key", "ascending"), ("path", "ascending")])
    # Longest text first, then the more specific host, then the text itself; block before allow.
    ranked = [(r["key"].encode(), r["rule_path"].encode(), (len(r["rule"]), len(r["key"]), r["rule"], r["verdict"])) for r in rules.to_pylist()]
    found = sweep([(k.encode(), p.encode()) for k, p in zip(pages["key"].to_pylist(), pages["path"].to_pylist())], ranked)
    return pages.select(["page_id", "host", "path"]).append_column("rule", pa.array([f and f[2] for f in found], pa.string())).append_column(
        "verdict", pa.array([f and f[3] for f in found], pa.string()))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` for each row of ``pages`` (page_id, url).

    ``rules`` has verdict, host and path. A rule fits its host and all subdomains if the page's path
    starts with its own; the longest wins (of equal ones the longer host, then the larger text, then
    block). Without a rule the verdict is ``default``. A url that is null or has no ``://`` has empty
    host and path, which no rule with a host fits. Rules with a null are left out. Repeated
    rows are judged one by one; without any rules all pages get ``default``.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pages = pages.withColumn("key", reversed_host(F.col("host")))
    rules = rules.dropna().select("verdict", F.translate("host", *_LETTERS).alias("host"), F.col("path").alias("rule_path"))
    rules = rules.select("verdict", "rule_path", F.concat("host", "rule_path").alias("rule"), reversed_host(F.col("host")).alias("key"))
    # Bounds from a bounded sample; they decide only who works on what.
    count = pages.count()
    parts = max(1, -(-count // range_rows))
    copies = -(-parts // SAMPLE)
    parts = -(-parts // copies)
    sample = sorted(r[0] for r in pages.select("key").sample(min(1.0, SAMPLE / max(count, 1)), seed=11).limit(2 * SAMPLE).collect()) if parts > 1 else []
    # Keys compare as UTF-8 bytes, as Spark sorts.
    bounds = np.array(sorted(sample[n * len(sample) // parts].encode() for n in range(1, parts)) if sample else [], dtype=object)

    def between(low: np.ndarray, high: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["low", "high"])

    def encoded(keys: pa.Array) -> np.ndarray:
        found = np.empty(len(keys), object)
        found[:] = [k or b"" for k in keys.cast(pa.binary()).to_pylist()]
        return found

    @F.arrow_udf("low long, high long")
    def page_ranges(keys: pa.Array) -> pa.Array:
        found = encoded(keys)
        return between(np.searchsorted(bounds, found, "left"), np.searchsorted(bounds, found, "right"))

    @F.arrow_udf("low long, high long")
    def rule_ranges(keys: pa.Array) -> pa.Array:
        found = encoded(keys)
        after = np.empty(len(found), object)
        after[:] = [k[:-1] + bytes([k[-1] + 1]) if k else k for k in found]
        return between(np.searchsorted(bounds, found, "left"), np.searchsorted(bounds, after, "left"))

    # A host that fills several ranges is dealt to all of them by id, and so is a stretch of keys with several copies.
    placed = pages.withColumn("r", page_ranges("key"))
    dealt = F.xxhash64("page_id", "path")
    spread = (F.col("r.low") + F.pmod(dealt, F.col("r.high") - F.col("r.low") + 1)) * copies + F.pmod(F.xxhash64(dealt), F.lit(copies).cast("long"))
    placed = placed.withColumn("range", spread).drop("r")
    copied = rules.distinct().withColumn("r", rule_ranges("key")).withColumn("range", F.explode(F.sequence(F.col("r.low") * copies, (F.col("r.high") + 1) * copies - 1))).drop("r")
    found = placed.groupBy("range").cogroup(copied.groupBy("range")).applyInArrow(
        _join, "page_id long, host string, path string, rule string, verdict string")
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def rules_table(spark, rules: list[Rule]) -> DataFrame:
    """A list of rules as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")

