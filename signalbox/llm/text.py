"""Words and shingles of many texts at once: hashes from running sums over the bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
"""Bytes of text that are hashed together; a longer text is hashed in pieces cut at white space."""
SHINGLE = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240501))
_CODES = _random.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _CODES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(_BASE, -1, 2**64)
_WEIGHTS = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTHS = _random.integers(0, 2**64, SHINGLE + 1, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 4096), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back to the system when its partition ends: workers stay for later stages."""

    @wraps(run)
    def lightly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # only the GNU library has it

    return lightly


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes, or of one longer text."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


class Words:
    """The words (runs of bytes that are not ASCII white space) of a range of texts.

    ``start`` and ``end`` are positions in ``data``, ``hash`` 64-bit values, and text ``i``
    has the words ``bound[i]`` to ``bound[i + 1]``.
    """

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, prefixes: tuple[int, ...] = (), kinds: np.ndarray | None = None
    ):
        self.data, self.offsets = data, offsets
        solid = ~_SPACE[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        if kinds is not None:
            # words are also cut between two bytes of different kinds above 0
            kind = kinds[data]
            cut = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            first[1:] |= cut
            last[:-1] |= cut
        full = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        first[heads], last[tails] = solid[heads], solid[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bound = np.searchsorted(self.start, offsets)
        codes = _FOLDED if fold else _CODES
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        self.prefix = {n: np.empty(len(self.start), dtype=np.uint64) for n in prefixes}
        at = 0
        while at < len(self.start):
            # as many whole words as fit into a piece, one longer word at least
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + CHUNK, side="right")))
            low, high = self.start[at], self.end[to - 1]
            running = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(codes[data[low:high]] * _power(_BASE, high - low), out=running[1:])
            back = _power(_INVERSE, high - low + 1)
            begin, stop = self.start[at:to] - low, self.end[at:to] - low
            self.hash[at:to] = mix((running[stop] - running[begin]) * back[begin] + (stop - begin).astype(np.uint64))
            for n, out in self.prefix.items():
                cut = np.minimum(begin + n, stop)
                out[at:to] = mix((running[cut] - running[begin]) * back[begin] + np.uint64(n << 32))
            at = to

    def counts(self) -> np.ndarray:
        return np.diff(self.bound)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts, and their bounds.

        A text with fewer than five words has its whole sequence as one shingle, a text
        without words none.
        """
        n = self.counts()
        w = self.hash
        if len(w) >= SHINGLE:
            m = len(w) - SHINGLE + 1
            full = w[:m] * _WEIGHTS[0]
            for i in range(1, SHINGLE):
                full += w[i : m + i] * _WEIGHTS[i]
            full = mix(full + _LENGTHS[SHINGLE])
        else:
            full = np.zeros(0, dtype=np.uint64)
        made = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
        bound = np.concatenate([[0], np.cumsum(made)])
        out = np.empty(bound[-1], dtype=np.uint64)
        owner = np.repeat(np.arange(len(n)), made)
        place = self.bound[:-1][owner] + np.arange(bound[-1]) - bound[:-1][owner]
        whole = (n >= SHINGLE)[owner]
        out[whole] = full[place[whole]]
        for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
            own = w[self.bound[i] : self.bound[i + 1]]
            out[bound[i]] = mix((own * _WEIGHTS[: len(own)]).sum(keepdims=True) + _LENGTHS[len(own)])[0]
        return out, bound


def words_of(
    column: pa.Array, fold: bool = True, prefixes: tuple[int, ...] = (), kinds: np.ndarray | None = None, limit: int = CHUNK
) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) for ranges of a string column."""
    data, offsets = texts(column)
    for first, last in spans(offsets, limit):
        low, high = offsets[first], offsets[last]
        yield first, last, Words(data[low:high], offsets[first : last + 1] - low, fold, prefixes, kinds)
