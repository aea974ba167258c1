"""Token ids of whole texts by the tokenizers library, at the cost of the distinct words.

A text is cut into pieces where the tokenizer cuts anyway: at white space, and between
ASCII letters, digits and signs.  A piece is encoded once per worker; texts are put
together from the ids of their pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

from signalbox.llm.text import Words, spans, texts

VOCABULARY = "word_bpe_49k.json"
END = 1
KEPT = 1_000_000
"""Pieces a worker remembers; beyond it the memory starts anew."""
_KINDS = np.zeros(256, dtype=np.uint8)
for _byte in range(0x21, 0x7F):
    _KINDS[_byte] = 1 if chr(_byte).isalpha() else 2 if chr(_byte).isdigit() else 3
_KINDS[ord("'")] = 0  # begins contractions, which are one piece
# Byte-level tokenizers show the bytes that are no visible Latin-1 characters as U+0100 and on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {byte: 0x100 + i for i, byte in enumerate(b for b in range(256) if b not in _VISIBLE)}
# The vocabulary's special tokens
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


class Pieces:
    """Ids of pieces by hash, in sorted arrays that grow by merging."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.new_keys, self.new_place = self.keys, self.place
        self.pool = np.zeros(1 << 20, dtype=np.uint16)
        self.used = 0
        self.lengths = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words without white space.

        Letters of the Latin blocks pass normalizer and pre-tokenizer unchanged but for their
        case, so such words go to the tokenizer's model at once, byte by byte.
        """
        model, ids, rest = self.tokenizer.model, [], []
        for i, word in enumerate(words):
            if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
                ids.append([t.id for t in model.tokenize(word.lower().encode().decode("latin-1").translate(_SHOWN))])
            else:
                ids.append([])
                rest.append(i)
        for i, coded in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            ids[i] = coded.ids
        return ids

    def _find(self, keys: np.ndarray, place: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, place[at], -1)

    def lookup(self, wanted: np.ndarray, piece) -> np.ndarray:
        """Entry numbers of sorted distinct hashes; ``piece(i)`` gives the text of the i-th."""
        if len(self.starts) > KEPT:
            self.clear()
        found = self._find(self.keys, self.place, wanted)
        open_ = np.flatnonzero(found < 0)
        if len(open_):
            found[open_] = self._find(self.new_keys, self.new_place, wanted[open_])
            open_ = open_[found[open_] < 0]
        if len(open_):
            ids = self.encode([piece(i) for i in open_])
            lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter((x for row in ids for x in row), dtype=np.uint16, count=int(lengths.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            number = len(self.starts) + np.arange(len(ids))
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used += len(flat)
            found[open_] = number
            self.new_keys, self.new_place = _merged(self.new_keys, self.new_place, wanted[open_], number)
            if len(self.new_keys) > 100_000:
                self.keys, self.place = _merged(self.keys, self.place, self.new_keys, self.new_place)
                self.new_keys, self.new_place = self.keys[:0], self.place[:0]
        return found


def _merged(keys: np.ndarray, place: np.ndarray, more: np.ndarray, more_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, more)
    return np.insert(keys, at, more), np.insert(place, at, more_place)


_pieces: dict[str, Pieces] = {}


def pieces(vocabulary: str = VOCABULARY) -> Pieces:
    if vocabulary not in _pieces:
        _pieces[vocabulary] = Pieces(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return _pieces[vocabulary]


def token_ids(column: pa.Array, vocabulary: str = VOCABULARY, end: int | None = END) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, bounds) for ranges of a string column.

    Text ``first + i`` has ``ids[bounds[i]:bounds[i + 1]]``, the end id last.  A null is an
    empty text and has the end id alone.  Ids are below 65,536.
    """
    known = pieces(vocabulary)
    data, offsets = texts(column)
    for first, last in spans(offsets):
        low, high = offsets[first], offsets[last]
        part = data[low:high]
        raw = part.tobytes()
        plain = not any(s in raw for s in SPECIAL)
        # special tokens are found before the text is folded and cut
        w = Words(part, offsets[first : last + 1] - low, plain, kinds=_KINDS if plain else None)
        hashes = w.hash if plain else w.hash ^ np.uint64(0x5BD1E995)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        begin, stop = w.start[at], w.end[at]
        entry = known.lookup(distinct, lambda i: raw[begin[i] : stop[i]].decode())
        lengths, starts = known.lengths[entry][inverse], known.starts[entry][inverse]
        n, extra = last - first, int(end is not None)
        total = np.concatenate([[0], np.cumsum(lengths)])
        bounds = total[w.bound] + np.arange(n + 1) * extra
        if extra:
            # the end id is one more piece after the words of each text
            lengths = np.insert(lengths, w.bound[1:], 1)
            starts = np.insert(starts, w.bound[1:], -1)
            total = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])
        ids = known.pool[source]
        if extra:
            ids[bounds[1:] - 1] = end
        yield first, last, ids, bounds


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
