"""Benchmark decontamination by a broadcast hash set of test n-grams.

Texts are lower-cased (A-Z) and split into words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is 10 consecutive words
of a benchmark item; an item with fewer, but at least one, is one window. The windows' hashes are broadcast, each
document's windows are looked up among them, and every hit is confirmed on the words themselves.

The hash set is broadcast only up to BROADCAST_BYTES of item text. A larger benchmark is dealt into parts of at most
that size, one pass over the documents for each; what a pass has found travels with the row to the next, and spans are
cut after the last.

A null text has no words, on either side. A null item_id marks words as hit but adds no item. Items that repeat count
once by id. A null doc_id is scanned like any other, and rows that repeat get a row each. An empty benchmark hits
nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, doc_rows, slices, small_batches, table, written
from .textscan import ALNUM, Words

WINDOW = 10
OUTPUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: The column in which hit words travel from pass to pass.
HITS = "__lumenfold_hits"
Index = dict[int, tuple[np.ndarray, dict[int, dict[bytes, tuple[str, ...]]]]]


def window_index(items: list[tuple[str | None, str]], window: int = WINDOW) -> Index:
    """By window length: sorted hashes, and by hash the windows' words with the ids of their items."""
    found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
    for item_id, text in items:
        w = Words(pa.array([text or ""]), ALNUM)
        n = len(w.hash)
        k = min(window, n)
        if not n:
            continue
        for at, h in zip(*w.windows(k), strict=True):
            ids = found.setdefault(k, {}).setdefault(int(h), {}).setdefault(w.joined(at, at + k), set())
            if item_id is not None:
                ids.add(item_id)
    return {k: (np.array(sorted(x), dtype=np.uint64), {h: {t: tuple(sorted(i)) for t, i in y.items()} for h, y in x.items()}) for k, x in found.items()}


def scan(w: Words, index: Index) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of the batch are hit, and the items by text."""
    hit = np.zeros(len(w.hash) + 1, dtype=np.int32)
    items: dict[int, set[str]] = {}
    for k, (hashes, texts) in index.items():
        at, h = w.windows(k)
        if not len(at):
            continue
        place = np.searchsorted(hashes, h)
        place[place == len(hashes)] = 0
        for a, x in zip(at[m := hashes[place] == h].tolist(), h[m].tolist(), strict=True):
            ids = texts[x].get(w.joined(a, a + k))
            if ids is not None:
                hit[a] += 1
                hit[a + k] -= 1
                doc = int(np.searchsorted(w.first, a, side="right")) - 1
                items.setdefault(doc, set()).update(ids)
    return np.cumsum(hit[:-1]) > 0, items


def _benchmark_parts(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items, in parts of at most about max_bytes; only one part is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    # A window's entry holds its words, so that an item's text stands WINDOW times in the index.
    parts = max(1, -(-int(total) * 2 * WINDOW // max_bytes))
    for i in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        yield [(r.item_id, r.text) for r in part.collect()]


def _pass(index, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM)
                hit, items = scan(w, index.value)
                before = part.column("hits").to_pylist()
                named = part.column("items").to_pylist()
                hits = []
                for i in range(part.num_rows):
                    own = hit[w.first[i] : w.first[i + 1]]
                    if before[i] is not None:
                        own = own | np.unpackbits(np.frombuffer(before[i], np.uint8), count=len(own)).astype(bool)
                    hits.append(own)
                    named[i] = sorted(set(named[i] or ()) | items.get(i, set()))
                if last:
                    n_hit = [int(x.sum()) for x in hits]
                    cols = [part.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64())]
                    cols += [pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]), pa.array([n > 0 for n in n_hit])]
                    yield pa.RecordBatch.from_arrays(cols, [x.split(" ")[0] for x in OUTPUT.split(", ")])
                else:
                    cols = [part.column("doc_id"), part.column("text"), pa.array([np.packbits(x).tobytes() for x in hits], pa.binary()), pa.array(named, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "hits", "items"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    spark = docs.sparkSession
    state = "doc_id long, text string, hits binary, items array<string>"
    rows = doc_rows(docs).select("doc_id", "text", F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    parts = _benchmark_parts(benchmark, max_bytes)
    now = next(parts)
    while True:
        index = spark.sparkContext.broadcast(window_index(now, window))
        now = next(parts, None)
        if now is None:
            return rows.mapInArrow(_pass(index, True), OUTPUT)
        rows = written(rows.mapInArrow(_pass(index, False), state), "decontaminate")


def _merged(hit: np.ndarray, before: bytes | None) -> np.ndarray:
    """Hit words of a text, with those of the passes before."""
    return hit if before is None else hit | np.unpackbits(np.frombuffer(before, np.uint8), count=len(hit)).astype(bool)


def _marker(index, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the hit words of a part to HITS; texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                w = Words(part.column(text_col), ALNUM)
                hit, _ = scan(w, index.value)
                hits = [_merged(hit[w.first[i] : w.first[i + 1]], x) for i, x in enumerate(part.column(HITS).to_pylist())]
                k = part.schema.get_field_index(HITS)
                yield part.set_column(k, part.schema.field(k), pa.array([np.packbits(x).tobytes() if x.any() else None for x in hits], part.schema.field(k).type))

    return run


def _cleaner(index, spans: bool, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                w = Words(part.column(text_col), ALNUM)
                hit, _ = scan(w, index.value)
                k = part.schema.get_field_index(HITS)
                if k >= 0:
                    for i, x in enumerate(part.column(k).to_pylist()):
                        hit[w.first[i] : w.first[i + 1]] = _merged(hit[w.first[i] : w.first[i + 1]], x)
                    part = part.remove_column(k)
                touched = [bool(hit[a:b].any()) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                if spans and any(touched):
                    texts = part.column(text_col).to_pylist()
                    for i in np.flatnonzero(touched):
                        raw, keep = texts[i].encode(), bytearray()
                        at, base = 0, int(w.offsets[i])
                        own = hit[w.first[i] : w.first[i + 1]].astype(np.int8)
                        edge = np.diff(own, prepend=0, append=0)
                        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                            keep += raw[at : int(w.starts[w.first[i] + a]) - base]
                            at = int(w.ends[w.first[i] + b - 1]) - base
                        texts[i] = (keep + raw[at:]).decode()
                    k = part.schema.get_field_index(text_col)
                    yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))
                elif not any(touched):
                    yield part
                else:
                    yield part.filter(pa.array([not t for t in touched]))

    return run


def remove_contamination(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, max_bytes: int = BROADCAST_BYTES, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the documents that have a hit word, or without the runs of hit words ('spans')."""
    small_batches(docs.sparkSession)
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r}")
    parts = _benchmark_parts(benchmark, max_bytes)
    now = next(parts)
    while True:
        index = docs.sparkSession.sparkContext.broadcast(window_index(now, window))
        now = next(parts, None)
        if now is not None and remove == "spans":
            docs = docs if HITS in docs.columns else docs.withColumn(HITS, F.lit(None).cast("binary"))
            docs = docs.mapInArrow(_marker(index, text_col), docs.schema)
        else:
            docs = docs.mapInArrow(_cleaner(index, remove == "spans", text_col), docs.drop(HITS).schema)
        if now is None:
            return docs
        docs = written(docs, "decontaminate")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
