"""Canonical length-limited Huffman codes for token ids, coded and decoded with whole arrays."""

from __future__ import annotations

import numpy as np

LIMIT = 20
"""Longest code: the decoding table has 2 ** 20 entries."""
STEP = 256
"""Ids between two checkpoints, from which decoding can start."""


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of every id by package-merge; 0 for ids that do not occur.

    Ties go to the smaller id, so equal counts give equal codes on every run.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, kinds = leaves, []
    is_leaf = np.ones(n, dtype=bool)
    for _ in range(limit - 1):
        kinds.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        merged, is_leaf = both[place], (np.arange(len(both)) < n)[place]
    kinds.append(is_leaf)
    take, lengths = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(kinds):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter ones first, equal lengths by id."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        own = lengths[order].astype(np.int64)
        room = 1 << (int(own[-1]) - own)
        out[order] = (np.concatenate([[0], np.cumsum(room)[:-1]]) >> (int(own[-1]) - own)).astype(np.uint64)
    return out


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id by leading bits, code length by leading bits, number of bits) for decoding."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return np.zeros(2, dtype=np.uint16), np.ones(2, dtype=np.uint8), 1
    own = lengths[order].astype(np.int64)
    bits = int(own[-1])
    room = 1 << (bits - own)
    ids, size = np.repeat(order, room).astype(np.uint16), np.repeat(own, room).astype(np.uint8)
    short = (1 << bits) - len(ids)  # only with a single id
    return np.concatenate([ids, np.repeat(ids[-1:], short)]), np.concatenate([size, np.repeat(size[-1:], short)]), bits


def encode(ids: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code texts; each begins at a whole byte.

    Returns the bytes, the texts' byte bounds, the checkpoints (bit offsets in the text of every
    STEP-th id) and the checkpoints' bounds.  Every text has one id at least.
    """
    size = lengths[ids].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    bits = before[bounds[1:]] - before[bounds[:-1]]
    byte_bounds = np.concatenate([[0], np.cumsum((bits + 7) >> 3)])
    n = np.diff(bounds)
    owner_shift = byte_bounds[:-1] * 8 - before[bounds[:-1]]
    at = before[:-1] + np.repeat(owner_shift, n)
    word = at >> 5
    value = code[ids] << (64 - (at & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(byte_bounds[-1] >> 2) + 3, dtype=np.uint32)
    filled = word[first]
    out[filled] = (np.bitwise_or.reduceat(value, first) >> np.uint64(32)).astype(np.uint32)
    out[filled + 1] |= (np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)).astype(np.uint32)
    marks = (n + STEP - 1) // STEP
    mark_bounds = np.concatenate([[0], np.cumsum(marks)])
    index = np.repeat(bounds[:-1] - mark_bounds[:-1] * STEP, marks) + np.arange(mark_bounds[-1]) * STEP
    offsets = before[index] - np.repeat(before[bounds[:-1]], marks)
    return np.frombuffer(out.astype(">u4").tobytes(), dtype=np.uint8)[: byte_bounds[-1]], byte_bounds, offsets.astype("<u4"), mark_bounds


def decode(data: np.ndarray, at: np.ndarray, counts: np.ndarray, decoder: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of all runs: run ``i`` begins at bit ``at[i]`` and has ``counts[i]`` ids.

    All runs advance together, one id a step; runs that end leave, the longest stay.
    """
    by_bits, size, bits = decoder
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    order = np.argsort(-counts, kind="stable")
    place = (np.concatenate([[0], np.cumsum(counts)[:-1]]))[order]
    at, left = at[order].astype(np.int64), counts[order]
    out = np.empty(int(counts.sum()), dtype=np.uint16)
    mask = np.uint32((1 << bits) - 1)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for step, n in enumerate(active):
        if n < len(at):
            at, place = at[:n], place[:n]
        seen = (window[at >> 3] >> (32 - bits - (at & 7)).astype(np.uint32)) & mask
        out[place + step] = by_bits[seen]
        at = at + size[seen]
    return out
