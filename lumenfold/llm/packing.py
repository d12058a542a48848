"""Sum-of-squares online packing of token sequences.

A document's ids, with an end id after them, fill whole windows first; what remains goes into the open window whose
choice gives the least sum of squared counts of partially filled windows, taken over all fill levels. The counts are
kept in a level array. Each task packs the rows of its own split, so no row is moved. At its end, or when
MAX_OPEN windows are open, it fills the fullest open windows with pieces cut from the emptiest, and cuts the last
one into windows whose lengths are powers of two, which need no padding.

A null text is empty: its document is the end id alone. A null doc_id is packed like any other, and rows that repeat
are packed once each. A text of any length is cut into windows. An empty table gives no sequence. A sequence id holds
the split's number and a count within it; both follow from the input, so a task that runs again gives the same ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import doc_rows, table

WINDOW = 1024
END_ID = 0
#: Open windows that a task holds at most; each keeps at most WINDOW ids.
MAX_OPEN = 4096
OUTPUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


class SumOfSquaresPacker:
    def __init__(self, window: int = WINDOW, first_sequence: int = 0, max_open: int = MAX_OPEN):
        self.window, self.next_id, self.max_open = window, first_sequence, max_open
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self._emit([Piece(doc_id, at, ids[at : at + self.window], total)])
            at += self.window
        if at < total:
            self._place(Piece(doc_id, at, ids[at:].copy(), total))

    def _level(self, size: int) -> int:
        """Fill level of the window that the size goes into; 0 for a new one. Ties go to the fuller window."""
        w, c = self.window, self.counts
        gain = np.where(c[1 : w - size + 1] > 0, 2 * c[size + 1 : w + 1] - 2 * c[1 : w - size + 1] + 2, np.iinfo(np.int64).max)
        if not len(gain):
            return 0
        if c[w - size]:
            gain[-1] = 1 - 2 * c[w - size]  # the window is full then and leaves the counts
        best = len(gain) - 1 - int(np.argmin(gain[::-1]))
        return best + 1 if gain[best] <= 2 * c[size] + 1 else 0

    def _place(self, piece: Piece) -> None:
        size = len(piece.ids)
        level = self._level(size)
        if level:
            held = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            self._emit(held)
        else:
            self.open[level + size].append(held)
            self.counts[level + size] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self.settle()

    def _emit(self, held: list[Piece]) -> None:
        at = 0
        for p in held:
            n = len(p.ids)
            self.rows.append((p.doc_id, p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, self.next_id, at))
            at += n
        self.next_id += 1

    def settle(self) -> None:
        """Close all open windows: the fullest take pieces of the emptiest, the last is cut into powers of two."""
        held = [(level, pieces) for level, windows in enumerate(self.open) for pieces in windows]
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.n_open = 0
        low, high = 0, len(held) - 1
        while low < high:
            level, pieces = held[high]
            while level < self.window and low < high:
                give = held[low][1]
                p = give.pop()
                if len(p.ids) > self.window - level:
                    p, rest = p.cut(self.window - level)
                    give.append(rest)
                pieces.append(p)
                level += len(p.ids)
                held[low] = (held[low][0] - len(p.ids), give)
                low += not give
            if level < self.window:
                held[high] = (level, pieces)
                break
            self._emit(pieces)
            high -= 1
        if low == high and held[low][1]:
            self._tail(held[low][1])

    def _tail(self, pieces: list[Piece]) -> None:
        rest, left = pieces[::-1], sum(len(p.ids) for p in pieces)
        while left:
            want, part = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                p = rest.pop()
                if len(p.ids) > want:
                    p, more = p.cut(want)
                    rest.append(more)
                part.append(p)
                want -= len(p.ids)
            self._emit(part)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _packer(path: str, window: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split(" ")[0] for x in OUTPUT.split(", ")]

    def shaped(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.load(path)
        packer = SumOfSquaresPacker(window, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                packer.add(doc_id.as_py(), np.concatenate([tokenizer.ids(text.as_py()), end]))
            if rows := packer.taken():
                yield shaped(rows)
        packer.settle()
        if rows := packer.taken():
            yield shaped(rows)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return doc_rows(docs).mapInArrow(_packer(tokenizer_path or bpe.default_path(), window, end_id), OUTPUT)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
