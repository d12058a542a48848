"""Word hashing over the UTF-8 bytes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(88172645463325252))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space ends: all but \x20 and \x09-\x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ words.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, 0 to n - 1."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, _CHUNK + 4096)
        made = []
        for base in (_P, _P_INV):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = made[0], made[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string array, and where each begins (one more for the end); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(low: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes; no run goes on from one text into the next."""
    inside = np.zeros(len(low) + 1, dtype=bool)
    inside[:-1] = kept[low]
    before = np.empty(len(low) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = np.zeros(len(low) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends


def hash_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; works through the bytes in chunks, so that memory follows the longest word."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + _CHUNK)))
        part = low[base : int(ends[j - 1])]
        power, inverse = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by the index of the first; texts are not told apart here."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += h[j : n + j]
    return mix(acc)


class Words:
    """Words of a batch of texts: hashes, byte bounds, and the first word of each text (one more for the end)."""

    def __init__(self, column: pa.Array, kept: np.ndarray):
        raw, self.offsets = utf8(column)
        self.low = LOWER[raw]
        self.starts, self.ends = word_bounds(self.low, self.offsets, kept)
        self.hash = hash_words(self.low, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each window of k words that lies within a text."""
        h = chain(self.hash, k)
        at = np.arange(len(h))
        last = np.repeat(self.first[1:], np.diff(self.first))[: len(h)]
        ok = at + k <= last
        return at[ok], h[ok]

    def whole(self, i: int) -> np.uint64:
        """Hash of all words of text i as one window."""
        a, b = self.first[i], self.first[i + 1]
        return chain(self.hash[a:b], int(b - a))[0]

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by a space."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))
