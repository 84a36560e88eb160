"""Find secrets in texts: by pattern, and values of credential fields that are too costly to guess.

Three patterns give the base spans: values assigned to a credential's name, access keys, and long hexadecimal
numbers. They miss values that are short or hold other signs. So every value in the context of a credential is
also weighed by what it would cost to guess: a dynamic programme over its characters finds the cheapest way to spell it
as words, dates, repeats, keyboard walks and characters tried by brute force. A value of at least ``GUESSES``
guesses that no base span touches is a span of kind ``guess``.

The words that a guesser would try are the most frequent ones of all the texts, values of credentials left
out; the rank of a word is its cost.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

KINDS = ("assign", "access", "hex", "guess")
GUESSES = 10.0
"""Decimal logarithm of the guesses from which a value is a secret."""
DICTIONARY_WORDS = 20_000
"""Words that a guesser knows; rarer ones are spelt. Bounds what is sent to the workers."""
SHORTEST_WORD, LONGEST_WORD = 3, 24
LONGEST_BLOCK = 32

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|secret|private)[_\x20-]?key)["'`]?
        (?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)
        (?:"([^"\s]+)"|'([^'\s]+)'|`([^`\s]+)`|([^\s"'`<>]+))""", re.I | re.A | re.X)
_PLACEHOLDER = re.compile(r"\$\{|\$\(|\{\{|%[sd(]|[A-Za-z][A-Za-z0-9+.-]*://")
_WORD = re.compile(rf"[^\W\d_]{{{SHORTEST_WORD},{LONGEST_WORD}}}")

# How characters of words are written otherwise, and the lines of a keyboard, plain and with shift.
_WRITTEN = str.maketrans("@4831!05$7", "abeliiosst")
_LINES = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
_SHIFTED = ["!@#$%^&*()_+", "QWERTYUIOP{}", "ASDFGHJKL:\"", "ZXCVBNM<>?"]
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"

_KEYS = {c: (row, place) for lines in (_LINES, _SHIFTED) for row, line in enumerate(lines) for place, c in enumerate(line)}
_STEPS = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
"""To the right and left, and to the two keys below and above on slanted lines."""
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
_DATES = [(re.compile(rf"(?=({p}))"), math.log10(cost)) for p, cost in (
    (_YEAR, 200), (rf"{_YEAR}{_MONTH}{_DAY}", 200 * 365), (rf"{_DAY}{_MONTH}{_YEAR}", 200 * 365), (rf"{_MONTH}{_DAY}{_YEAR}", 200 * 365),
    (rf"{_YEAR}[-/._]{_MONTH}[-/._]{_DAY}", 3 * 200 * 365), (rf"{_DAY}[-/._]{_MONTH}[-/._]{_YEAR}", 3 * 200 * 365),
    (rf"{_MONTH}[-/._]{_DAY}[-/._]{_YEAR}", 3 * 200 * 365))]
_CHOICE = math.log10(5)
"""Which of the five kinds of span comes next."""


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def _step(a: str, b: str) -> tuple | None:
    """The direction from one character to the next on the keyboard, or along the alphabet."""
    if a in _KEYS and b in _KEYS:
        step = (_KEYS[b][0] - _KEYS[a][0], _KEYS[b][1] - _KEYS[a][1])
        if step in _STEPS:
            return step
    along = ord(b.lower()) - ord(a.lower())
    return ("abc", along) if a.lower() in _ALPHABET and b.lower() in _ALPHABET and along in (1, -1) else None


def _words(value: str, start: int, ranks: dict[str, int]) -> Iterator[tuple[int, float]]:
    lower = value[start:start + LONGEST_WORD].lower()
    plain = lower.translate(_WRITTEN)
    for length in range(SHORTEST_WORD, len(lower) + 1):
        written, meant = lower[:length], plain[:length]
        for word, swaps in {written: 0, meant: sum(a != b for a, b in zip(written, meant))}.items():
            if word in ranks:
                capitals = sum(c.isupper() for c in value[start:start + length])
                cased = 0.0 if not capitals else 1.0 if capitals == length or value[start].isupper() and capitals == 1 else math.log2(math.comb(length, capitals)) + 1
                yield start + length, math.log10(ranks[word]) + math.log10(2) * (cased + swaps)


def _dates(value: str) -> dict[int, list[tuple[int, float]]]:
    found: dict[int, list[tuple[int, float]]] = {}
    for pattern, cost in _DATES:
        for match in pattern.finditer(value):
            found.setdefault(match.start(1), []).append((match.end(1), cost))
    return found


def _walks(value: str, start: int, steps: list) -> Iterator[tuple[int, float]]:
    """Three and more neighbouring keys: the first key, the length, and each change of direction are guessed."""
    turns = 0
    for end in range(start + 1, min(len(value), start + LONGEST_BLOCK)):
        if steps[end - 1] is None:
            return
        turns += end > start + 1 and steps[end - 1] != steps[end - 2]
        if end >= start + 2:
            yield end + 1, math.log10(47) + math.log10(end + 1 - start) + turns * math.log10(6)


def guess_cost(value: str, ranks: dict[str, int], enough: float = math.inf) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` costs.

    Once every way on from some point costs ``enough``, that is the answer. ``ranks`` are the places of known words.
    """
    count = len(value)
    steps = [_step(a, b) for a, b in zip(value, value[1:])] + [None]
    dates, best = _dates(value), [0.0] + [math.inf] * count
    # For each length of a block: how many characters before this place equal those a block earlier.
    alike = [0] * (LONGEST_BLOCK + 1)
    blocks: dict[str, float] = {}

    def block_cost(block: str) -> float:
        if block not in blocks:
            blocks[block] = guess_cost(block, ranks)
        return blocks[block]

    for end in range(count + 1):
        repeating = False
        if end:
            best[end] = min(best[end], best[end - 1] + _brute(value[end - 1]))
            for size in range(1, min(LONGEST_BLOCK, end - 1) + 1):
                alike[size] = alike[size] + 1 if value[end - 1] == value[end - 1 - size] else 0
                repeating |= alike[size] >= size
                if alike[size] >= size:
                    times = alike[size] // size + 1
                    cost = best[end - times * size] + block_cost(value[end - size:end]) + math.log10(times) + _CHOICE
                    best[end] = min(best[end], cost)
        if not repeating and min(best[max(0, end - LONGEST_BLOCK):count + 1]) >= enough:
            return enough
        spans = [*_words(value, end, ranks), *dates.get(end, ()), *(_walks(value, end, steps) if end < count else ())]
        for after, cost in spans:
            best[after] = min(best[after], best[end] + cost + _CHOICE)
    return min(best[count], enough)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three patterns: whole matches that are long enough."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def credential_values(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each value in the context of a credential, without quotes and final punctuation."""
    for match in _CONTEXT.finditer(text):
        start, end = match.span(match.lastindex)
        if match.lastindex == 4:
            end = start + len(text[start:end].rstrip(".,;:!?)]}"))
        if end > start and not _PLACEHOLDER.match(text, start, end):
            yield start, end


def secret_spans(text: str, weigh) -> list[tuple[str, int, int]]:
    """All spans of a text by start and kind; ``weigh`` gives the cost of a value."""
    found = base_spans(text)
    found += [("guess", start, end) for start, end in credential_values(text)
              if not any(s < end and start < e for _, s, e in found) and weigh(text[start:end]) >= GUESSES]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            if text:
                for start, end in reversed([m.span(m.lastindex) for m in _CONTEXT.finditer(text)]):
                    text = text[:start] + " " + text[end:]
                counts.update(_WORD.findall(text.lower()))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> dict[str, int]:
    """The rank of each of the most frequent words of all texts: how many are at least as frequent.

    Words are runs of 3 to 24 letters, lower-cased. Words of one count go in together or not at all.
    """
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # One row per distinct count: their number grows with the root of the number of words.
    ranks = counts.groupBy("n").count().withColumn("rank", F.sum("count").over(Window.orderBy(F.desc("n"))))
    ranks = ranks.where(F.col("rank") <= most).select("n", "rank")
    return {r.word: r.rank for r in counts.join(F.broadcast(ranks), "n").select("word", "rank").collect()}


def scan(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """``doc_id``, ``spans`` (kind, start, end) of each row of ``docs`` (doc_id, text, …), and ``row``, a struct of its other columns.

    Places count code points of the whole text; ends are exclusive. Spans are ordered by start, then by kind as in ``KINDS``. The words are
    those of ``docs`` unless ``ranks`` are given. Null and empty texts have no spans; repeated rows and null ids are answered one by one.
    """
    ranks = dictionary(docs) if ranks is None else ranks
    others = [f for f in docs.schema.fields if f.name.lower() not in ("doc_id", "text")]
    row = [F.struct(*[F.col(f"`{f.name}`").alias(f"c{n}") for n, f in enumerate(others)]).alias("row")] if others else []
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies repeat their values.
        weigh = functools.lru_cache(100_000)(lambda value: guess_cost(value, ranks, GUESSES))
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(t, weigh)] if t else [] for t in batch.column("text").to_pylist()]
            more = {"row": batch.column("row")} if "row" in batch.schema.names else {}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind), **more})

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(span)), *([named.schema["row"]] if others else [])])
    found = named.mapInArrow(run, schema)
    if not others:
        return found
    return found.withColumn("row", F.struct(*[F.col("row")[f"c{n}"].alias(f.name) for n, f in enumerate(others)]))
