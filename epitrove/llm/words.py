"""Words of Arrow string columns as numpy arrays: where they lie and a 64-bit hash of each.

A word is a run of bytes other than the six ASCII white-space bytes. Nothing here loops over words
in Python: a slice of documents is hashed with prefix sums over its bytes. A word's hash is made of two polynomials
of its bytes modulo two primes. (Modulo a power of two, words can be written down that collide for every base.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
"""Documents are worked on in slices of about so many bytes; a longer document is a slice of its own."""

_FIELDS = ((0x5BD1E995, 2_147_483_647), (0x27D4EB2F, 2_147_483_629))
"""Base and prime modulus of each polynomial; a product of two residues fits into 64 bits."""
_LONGEST_PLAIN = 1 << 24
"""Terms of words up to so many bytes are summed without being reduced."""
_MODULUS = 1 << 64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_LETTERS = np.ones(256, bool)
"""For ``Words``: words are runs of ASCII letters and of bytes of longer characters."""
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, count: int) -> np.ndarray:
    """base**0 … base**(count-1) modulo a prime below 2**31; kept up to the size of a slice."""
    kept = _powers.get((base, prime))
    if kept is None or len(kept) < count:
        kept = np.ones(max(count, SLICE_BYTES + 1), np.uint32)
        done, step = 1, base % prime
        while done < len(kept):
            more = min(done, len(kept) - done)
            kept[done:done + more] = kept[:more] * np.uint64(step) % np.uint64(prime)
            done, step = done + more, step * step % prime
        if len(kept) <= SLICE_BYTES + 1:
            _powers[base, prime] = kept
    return kept[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most ``most`` bytes each, or with one row."""
    _, offsets = text_bytes(column)
    start, count = 0, len(offsets) - 1
    while start < count:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), count)
        yield start, end
        start = end


class Words:
    """The words of some documents, in order: ``starts`` and ``ends`` in ``data``, ``doc``, ``hashes``.

    ``first`` has the number of words before each document, and the total as its last entry.
    """

    def __init__(self, column: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACES) -> None:
        data, offsets = text_bytes(column)
        self.data, self.offsets = data, offsets
        if lower:
            data = LOWER[data]
        inside = ~breaks[data]
        edges = np.zeros(len(data) + 1, bool)
        edges[offsets] = True
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        if len(data):
            before[1:] = ~inside[:-1] | edges[1:-1]
            after[:-1] = ~inside[1:] | edges[1:-1]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        longest = int((self.ends - self.starts).max(initial=0))
        self._sums = []
        for base, prime in _FIELDS:
            terms = (data.astype(np.uint64) + np.uint64(1)) * powers(base, prime, len(data))
            if longest > _LONGEST_PLAIN:
                terms %= np.uint64(prime)
            # A sum may overflow; the difference of two that are less than 2**64 apart is right all the same.
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self._sums.append(sums)
        self.hashes = self.prefixes(None)

    def __len__(self) -> int:
        return len(self.starts)

    def prefixes(self, size: int | None) -> np.ndarray:
        """A hash of the first ``size`` bytes of each word; of all if None."""
        ends = self.ends if size is None else np.minimum(self.ends, self.starts + size)
        both = np.zeros(len(self), np.uint64)
        for (base, prime), sums in zip(_FIELDS, self._sums):
            shift = powers(pow(base, -1, prime), prime, len(self.data) + 1)[self.starts]
            both = (both << np.uint64(32)) + (sums[ends] - sums[self.starts]) % np.uint64(prime) * shift % np.uint64(prime)
        return mix(both + np.uint64(1))

    def windows(self, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words within one document, and the word each starts at."""
        if len(self) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.flatnonzero(self.doc[:len(self) - size + 1] == self.doc[size - 1:])
        base = (0xD6E8FEB86659FD93 + 2 * seed) & (_MODULUS - 1) | 1
        runs = self.hashes[:len(self) - size + 1].copy()
        high = np.empty_like(runs)
        for place in range(1, size):
            # Folding the high bits in keeps it from being a polynomial.
            np.right_shift(runs, np.uint64(32), out=high)
            runs ^= high
            runs *= np.uint64(base)
            runs += self.hashes[place:place + len(runs)]
        return mix(runs[starts] + np.uint64(base)), starts

    def whole(self) -> np.ndarray:
        """One hash for the whole word sequence of each document."""
        out = np.zeros(len(self.counts), np.uint64)
        held = np.flatnonzero(self.counts)
        if len(held):
            place = np.arange(len(self)) - self.first[self.doc]
            terms = mix(self.hashes + place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            out[held] = mix(np.add.reduceat(terms, self.first[:-1][held]) + self.counts[held].astype(np.uint64))
        return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each range, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
