"""Near-duplicates by b-bit MinHash.

A document's set is its distinct shingles of five words (A-Z lower-cased, split at white space). Documents with equal
sets form a class, which goes by a number of its own until components are named. A class has MINIMA minima under as many hash functions;
BANDS keys of ROWS minima each find candidates, and the LOW_BITS low bits of each minimum, packed in longs, estimate
the similarity of a pair by counting equal groups of bits and correcting for those equal by chance. Pairs whose
estimate reaches the threshold less MARGIN are confirmed on the full sets.

Candidates are taken in two steps. First every member of a key is tested against the smallest number under it and, in
PICK_BANDS bands, against a member picked by hash: this is linear in the members, and joins large groups of near copies
without expanding them. Then, under keys whose members are in several components, all pairs across components are
compared by a signature of SHARP_MINIMA minima (within the join, which returns each pair once, if it may be similar enough)
and confirmed. Pairs within a component need no test, and no other pair that shares a key goes without one. A pair at
the threshold shares a key with probability 1 - (1 - 0.75^5)^48, that is all but 2 in a million; its estimate falls
short by chance (5 standard errors) more rarely still. Shingles are compared by 64-bit hashes.

Fewer than five words make one shingle. A text that is null, empty or all white space has an empty set and is linked
with nothing. Rows are documents by themselves, also where they share a doc_id: identical ones get identical rows. A
component goes by its smallest doc_id, whose rows in it are kept; texts under one doc_id can be in different components.
A null doc_id is not linked, has a null component_id and is kept. Other columns, whatever their names, play no part. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import doc_rows, hot_join, slices, table, written
from .textscan import SPACED, Words, mix

SHINGLE = 5
SIMILARITY = 75, 100
BANDS, ROWS = 48, 5
MINIMA = BANDS * ROWS
LOW_BITS = 4
MARGIN = 0.15
#: Bands whose keys also have a picked member that all others are tested against.
PICK_BANDS = 8
#: The sharper signature that documents of unsettled keys get.
SHARP_MINIMA, SHARP_BITS, SHARP_MARGIN = 2048, 2, 0.06
#: Its first minima, which settle most pairs.
QUICK_MINIMA, QUICK_MARGIN = 256, 0.17
#: Rows of a key that others are compared with at a time.
SHARE = 4096
LONGS = MINIMA * LOW_BITS // 64
SKETCH = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, bits array<long>"

_rng = np.random.Generator(np.random.PCG64(5711))
_A = _rng.integers(1, 2**32, SHARP_MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, SHARP_MINIMA, dtype=np.uint32)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, SPACED)
    at, h = w.windows(k)
    bounds = np.searchsorted(at, w.first)
    out = []
    for i, n in enumerate(np.diff(w.first)):
        out.append(np.unique(h[bounds[i] : bounds[i + 1]]) if n >= k else np.array([w.whole(i)] if n else [], dtype=np.uint64))
    return out


def minima(sets: list[np.ndarray], n: int = MINIMA) -> np.ndarray:
    """The first n minima of each non-empty set, a row for each."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), dtype=np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
    return out


def packed(m: np.ndarray, low_bits: int) -> np.ndarray:
    """The low bits of each minimum, 64 / low_bits of them to a long."""
    per = 64 // low_bits
    low = (mix(m.astype(np.uint64)) & np.uint64((1 << low_bits) - 1)).reshape(len(m), m.shape[1] // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(low_bits)), axis=2).view(np.int64)


def sketches(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits."""
    rows = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (len(m), BANDS)).copy()
    for j in range(ROWS):
        keys = mix(keys ^ rows[:, :, j])
    return keys.view(np.int64), packed(m, LOW_BITS)


def _lists(rows: np.ndarray, at: list[int], n: int) -> pa.Array:
    """A list column of n rows that holds rows at the given places and nulls elsewhere."""
    sizes = np.zeros(n, dtype=np.int32)
    sizes[at] = rows.shape[1]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(sizes == 0, False))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, bits = sketches(minima([sets[i] for i in full])) if full else (np.empty((0, BANDS), np.int64), np.empty((0, LONGS), np.int64))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            cols = [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())]
            cols += [_lists(keys, full, len(sets)), _lists(bits, full, len(sets))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "digest", "bands", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            cols = [part.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "items"])


def _sharp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [x if len(x) else np.zeros(1, np.uint64) for x in shingle_sets(part.column("text"))]
            bits = packed(minima(sets, SHARP_MINIMA), SHARP_BITS)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(bits, list(range(len(sets))), len(sets))], ["doc_id", "sharp"])


def equal_groups(a: Column, b: Column, n: int, low_bits: int) -> Column:
    """How many of n groups of low_bits bits are equal in two packed signatures."""
    mask = int("1".rjust(low_bits, "0") * (64 // low_bits), 2)
    ones = F.lit(mask - (1 << 64) if mask >> 63 else mask)

    def differing(x: Column) -> Column:
        shift = 1
        while shift < low_bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        return F.bit_count(x.bitwiseAND(ones))

    longs = n * low_bits // 64
    if longs <= 16:  # written out, so that it is compiled with the join; more would be too long a method
        return F.lit(n) - sum((differing(a[i].bitwiseXOR(b[i])) for i in range(1, longs)), differing(a[0].bitwiseXOR(b[0])))
    return F.lit(n) - F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def estimated(a: Column, b: Column, n: int = MINIMA, low_bits: int = LOW_BITS) -> Column:
    """Similarity from equal groups; 2^-low_bits of the others are equal by chance."""
    chance = 2.0**-low_bits
    return (equal_groups(a, b, n, low_bits) / F.lit(float(n)) - chance) / (1 - chance)


def _likely(a: Column, b: Column, margin: float, n: int = MINIMA, low_bits: int = LOW_BITS) -> Column:
    return estimated(a, b, n, low_bits) >= SIMILARITY[0] / SIMILARITY[1] - margin


def _first_shared(a: str, b: str) -> Column:
    """Whether the key two rows meet under is the first one they share, so that a pair comes up once."""
    before = lambda x: F.slice(F.col(f"{x}.bands"), F.lit(1), F.array_position(F.col(f"{x}.bands"), F.col("a.key")).cast("int") - 1)
    return ~F.arrays_overlap(before(a), before(b))


def _of(texts: DataFrame, reps: DataFrame, ids: DataFrame, make, schema: str, label: str) -> DataFrame:
    """What `make` gives for the classes of some numbers; only the texts that stand for them are moved."""
    wanted = reps.join(ids.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi").select("node", "rep", "rep_hash").hint("shuffle_hash")
    found = texts.join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select(F.col("node").alias("doc_id"), "text")
    return written(found.mapInArrow(make, schema), label)


def _confirmed(pairs: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (u, v), those whose full sets are similar enough."""
    ids = pairs.select(F.col("u").alias("doc_id")).distinct().unionByName(pairs.select(F.col("v").alias("doc_id")).distinct())
    sets = _of(texts, reps, ids, _sets, "doc_id long, items array<long>", "sets")
    u = sets.select(F.col("doc_id").alias("u"), F.col("items").alias("a"))
    v = sets.select(F.col("doc_id").alias("v"), F.col("items").alias("b"))
    least, of = SIMILARITY
    close = F.size(F.array_intersect("a", "b")) * F.lit(least + of) >= (F.size("a") + F.size("b")) * F.lit(least)
    return written(pairs.join(u, "u").join(v, "v").where(close).select("u", "v"), "links", small=True)


def find_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash of each row of docs."""
    texts = doc_rows(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = written(texts.select("doc_id", "text_hash", "text").mapInArrow(_sketch, SKETCH), "sketch")
    reps = rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("rep_hash"), F.count("*").alias("n"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "classes")
    # From here to the naming of components, doc_id is the number of a class: rows of unlike texts may share a doc_id.
    standing = (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
    classes = written(
        rows.select("doc_id", "text_hash", "digest", "bands", "bits").join(reps.select(F.col("digest").alias("d"), "rep", "rep_hash", "node").hint("shuffle_hash"), standing).select(F.col("node").alias("doc_id"), "bands", "bits"),
        "signatures",
    )
    bits = classes.select("doc_id", "bits")
    banded = classes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    # Keys with several members only: most have one. `pick` is a member that differs from key to key.
    pick = F.when(F.col("band") < PICK_BANDS, F.struct(F.xxhash64("key", "doc_id").alias("h"), F.col("doc_id").alias("p")))
    lead = banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(pick).alias("pick"), F.count("*").alias("n")).where("low < high")
    lead = written(lead.select("key", "low", F.col("pick.p").alias("pick"), "n"), "leaders")
    members = written(hot_join(banded.select("doc_id", "key"), lead.drop("n").hint("shuffle_hash"), "key", lead.select("key", "n"), BANDS * classes.count()), "members")

    tested = members.select(F.explode(F.array_compact(F.array("low", "pick"))).alias("p"), "doc_id").where("p <> doc_id")
    tested = written(tested.select(F.least("p", "doc_id").alias("u"), F.greatest("p", "doc_id").alias("v")).distinct(), "pairs", small=True)
    a = bits.select(F.col("doc_id").alias("u"), F.col("bits").alias("a"))
    b = bits.select(F.col("doc_id").alias("v"), F.col("bits").alias("b"))
    near = tested.join(a, "u").join(b, "v").where(_likely(F.col("a"), F.col("b"), MARGIN)).select("u", "v")
    links = _confirmed(written(near, "near", small=True), texts, reps)

    # Keys whose members are in several components: the pairs across them, by a sharper estimate.
    found = written(connected_components(links), "components", small=True)
    placed = written(members.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "placed")
    # The largest component of a key (ties: the smallest number), from counts of each: no list of them is kept.
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_keys = counted.groupBy("key").agg(F.count("*").alias("components"), F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("n")).where("components > 1")
    open_keys = written(open_keys.select("key", "main", "n", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), "open", small=True)
    left = hot_join(placed, open_keys.drop("n").hint("shuffle_hash"), "key", open_keys.select("key", "n"), max(1, placed.count()))
    left = written(left.withColumn("main", F.col("component") == F.col("main")), "unsettled")
    sharp = _of(texts, reps, left.select("doc_id"), _sharp, "doc_id long, sharp array<long>", "sharp")
    left = written(left.join(written(sharp.join(classes.select("doc_id", "bands"), "doc_id"), "sharp"), "doc_id"), "rest")
    # A key's most frequent component isn't joined with itself, row by row; the others meet all rows of the key, SHARE at a time.
    a = left.where(~F.col("main")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("a")
    b = left.withColumn("share", F.pmod(F.xxhash64("doc_id"), "shares").cast("int")).alias("b")
    across = (F.col("a.key") == F.col("b.key")) & (F.col("a.share") == F.col("b.share")) & (F.col("a.component") != F.col("b.component")) & (F.col("b.main") | (F.col("a.doc_id") < F.col("b.doc_id")))
    across &= _likely(F.col("a.sharp"), F.col("b.sharp"), QUICK_MARGIN, QUICK_MINIMA, SHARP_BITS)
    rest = a.join(b, across & _likely(F.col("a.sharp"), F.col("b.sharp"), SHARP_MARGIN, SHARP_MINIMA, SHARP_BITS) & _first_shared("a", "b"))
    rest = rest.select(F.least("a.doc_id", "b.doc_id").alias("u"), F.greatest("a.doc_id", "b.doc_id").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
    more = _confirmed(written(rest, "near", small=True), texts, reps)
    if not more.isEmpty():
        found = written(connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components", small=True)
    low = written(found.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low")), "named", small=True)
    named = found.join(low, "component").select("node", "low")
    classed = written(reps.join(named, "node", "left").select("digest", F.coalesce("low", "rep").alias("class_component"), "n"), "classed")
    out = hot_join(rows.select("doc_id", "text_hash", "n_shingles", "digest"), classed.drop("n"), "digest", classed.select("digest", "n"), rows.count(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each component."""
    gone = written(find_near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__lumenfold_id"), F.col("text_hash").alias("__lumenfold_hash")).distinct(), "dropped", small=True)
    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__lumenfold_id")) & (hashed == F.col("__lumenfold_hash")), "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
