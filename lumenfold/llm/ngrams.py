"""Hashed character n-grams of many texts, and bounded samples of labelled rows to fit on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import utf8

_rng = np.random.Generator(np.random.PCG64(40961))
#: Factors of a character's hash, of a step to a longer n-gram, and of each order.
_CHAR, _STEP = (np.uint32(x | 1) for x in _rng.integers(2**31, 2**32, 2, dtype=np.uint64))
_ORDER = _rng.integers(0, 2**32, 16, dtype=np.uint32) | np.uint32(1)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, A-Z lower-cased, and where each text begins (one more for the end); nulls are empty."""
    raw, offsets = utf8(texts)
    first = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points), first[offsets]


class NGrams:
    """Buckets of the n-grams of each text, for each order."""

    def __init__(self, texts: pa.Array, orders: tuple[int, ...], bits: int):
        self.orders, self.bits, self.hashes = orders, bits, []
        points, self.offsets = characters(texts)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        self.left = self.offsets[1:][self.doc] - np.arange(len(points))  # characters from here to the end of the text
        char = points * _CHAR
        char ^= char >> np.uint32(15)
        acc = np.zeros(len(points), dtype=np.uint32)
        for n in range(1, max(orders) + 1):
            size = max(0, len(points) - n + 1)
            acc = acc[:size] * _STEP + char[len(points) - size :]
            if n in orders:
                self.hashes.append(((acc ^ (acc >> np.uint32(16))) * _ORDER[n]) >> np.uint32(32 - bits))

    def of(self, i: int) -> np.ndarray:
        """Buckets of text i, one for each n-gram."""
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(self.orders, self.hashes, strict=True)])

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the text and the bucket of each n-gram that lies within a text."""
        for n, h in zip(self.orders, self.hashes, strict=True):
            ok = np.flatnonzero(self.left[: len(h)] >= n)
            yield self.doc[ok], h[ok]

    def distinct(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and bucket, each pair once and in order, of the n-grams whose bucket is used."""
        keys = []
        for n, h in zip(self.orders, self.hashes, strict=True):
            at = np.flatnonzero(used[h])
            at = at[self.left[at] >= n]
            keys.append((self.doc[at] << self.bits) | h[at].astype(np.int64))
        found = np.unique(np.concatenate(keys))
        return found >> self.bits, found & ((1 << self.bits) - 1)


def bounded_sample(rows: DataFrame, label: str, per_label: int, total: int, most_labels: int) -> tuple[DataFrame, dict]:
    """doc_id and label of at most per_label rows of each label (about) and `total` rows in all, and all rows by label.

    Rows are picked by a hash of the doc_id: the sample is the same in every run, and has the same size at any scale. Of
    more than most_labels labels, those with the most rows are taken (ties: the first in order).
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(most_labels)
    counts = {r[label]: r.n for r in counts.collect()}
    per_label = min(per_label, max(1, total // max(1, len(counts))))
    if not counts:
        return rows.select("doc_id", label).limit(0), counts
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, per_label / n)) for k, n in counts.items()], f"`{label}` {rows.schema[label].dataType.simpleString()}, __share double")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = rows.join(F.broadcast(shares), label).where(h < F.col("__share") * float(1 << 30)).select("doc_id", label)  # most_labels rows
    return picked.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(total), counts
