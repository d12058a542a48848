"""Exact top-k by inner product, with block-at-a-time pruning.

Vectors become integers, floor(256 * x). Rows are put in order of a coarse centre (of a bounded sample) and of vec_id,
and ranges of BLOCK rows in that order make blocks. A component and its sign are the terms: a block stores each
component's largest and smallest value, and its vectors as a forward index. For a query, the sums of the terms' maxima
bound every score in a block; blocks are visited in falling order of that bound, whole blocks are scored through
their forward index, and a query stops when the bound is below its k-th best score. Queries that visit the same block
next share one matrix product. A sample's exact k-th best score is where every task starts, and tasks' lists are merged.

The stated queries (vec_id divisible by 50) go over the index in batches of QUERIES rows at most, by broadcast.
Vectors that are null, empty, or hold a null or non-finite component take no part, nor do null vec_ids. Vectors of
another length than the query's are not its candidates. Ties go to the smaller vec_id. Rows that repeat a vec_id are
candidates each; as a query, the smallest such vector stands for all. Sums beyond 64 bits are cut to the nearest long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK = 128
QUERIES = 8192
#: Rows sampled for centres and for first thresholds.
SAMPLE, CENTRES = 2048, 64
SCALE = 256
LOW = np.iinfo(np.int64).min
INDEX = "dim int, ids array<long>, forward binary, low array<long>, high array<long>"
HITS = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long>, of the rows that take part."""
    x = F.col("x")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite).select("vec_id", F.transform(x, lambda e: F.floor(e * SCALE).cast("long")).alias("v"))


def _top(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers: by floating point where that is exact, else by Python's integers, cut to 64 bits."""
    if a.shape[1] * _top(a) * _top(b) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    full = a.astype(object) @ b.astype(object).T
    return np.clip(full, LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and block, the sum over components of the largest product."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return products(np.hstack([up, down]), np.hstack([high, low]))


class TopK:
    """The k best so far of each query."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.floor, self.k = ids, q, floor, k
        self.score = np.full((len(ids), k), LOW, dtype=np.int64)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max, dtype=np.int64)

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        """Score the queries at `rows` against a block."""
        s = products(self.q[rows], block)
        s[ids[None, :] == self.ids[rows][:, None]] = LOW
        better = (s >= self.kth()[rows][:, None]).any(axis=1)
        rows, s = rows[better], s[better]
        if len(rows):
            s = np.hstack([self.score[rows], s])
            v = np.hstack([self.vec[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
            order = np.lexsort((v, np.where(s == LOW, np.iinfo(np.int64).max, -s)), axis=1)[:, : self.k]
            self.score[rows], self.vec[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)

    def visit(self, blocks: list[tuple[np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray) -> int:
        """Go through blocks (ids, vectors), for each query in falling order of its bounds; the number of blocks scored, summed over queries."""
        bound = bounds(self.q, low, high)
        order = np.argsort(-bound, axis=1, kind="stable")
        alive, done = np.arange(len(self.ids)), 0
        for r in range(len(blocks)):
            at = order[alive, r]
            ok = bound[alive, at] >= self.kth()[alive]
            alive, at = alive[ok], at[ok]
            if not len(alive):
                break
            done += len(alive)
            by = np.argsort(at, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                self.add(alive[part], *blocks[at[part[0]]])
        return done


def _assign(centres) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros(batch.num_rows, dtype=np.int32)
            vectors = batch.column("v").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for dim, c in centres.value.items():
                if len(own := np.flatnonzero(sizes == dim)):
                    x = np.array([vectors[i] for i in own], dtype=np.float64)
                    at[own] = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(at), batch.column("vec_id"), batch.column("v")], ["dim", "centre", "vec_id", "v"])

    return run


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def made() -> pa.RecordBatch:
            m = np.array(vectors, dtype=np.int64)
            cols = [pa.array([m.shape[1]], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())]
            cols += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (m.min(axis=0), m.max(axis=0))]
            return pa.RecordBatch.from_arrays(cols, ["dim", "ids", "forward", "low", "high"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if vectors and (len(vectors) == size or len(v) != len(vectors[0])):
                    yield made()
                    ids, vectors = [], []
                ids.append(i)
                vectors.append(v)
        if vectors:
            yield made()

    return run


def _centres(sample: list, n: int) -> dict[int, np.ndarray]:
    """By vector length: centres of the sampled vectors, after a few rounds of k-means."""
    out = {}
    for dim in {len(r.v) for r in sample}:
        x = np.array([r.v for r in sample if len(r.v) == dim], dtype=np.float64)
        c = x[:: max(1, len(x) // n)][:n].copy()
        for _ in range(8):
            near = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = x[near == j].mean(axis=0)
        out[dim] = c
    return out


def build_index(vectors: DataFrame, sample: list, block: int = BLOCK) -> DataFrame:
    """The block index: a row for each block, all vectors in one."""
    centres = vectors.sparkSession.sparkContext.broadcast(_centres(sample, CENTRES))
    rows = vectors.mapInArrow(_assign(centres), "dim int, centre int, vec_id long, v array<long>")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "dim", "centre", "vec_id").sortWithinPartitions("dim", "centre", "vec_id")
    return written(rows.mapInArrow(_blocks(block), INDEX), "block-index")


def _searcher(queries, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: TopK(ids, q, floor, k) for dim, (ids, q, floor) in queries.value.items()}
        for batch in batches:
            by_dim: dict[int, list[dict]] = {}
            for row in batch.to_pylist():
                by_dim.setdefault(row["dim"], []).append(row)
            for dim, rows in by_dim.items():
                if dim in best:
                    blocks = [(np.array(r["ids"], dtype=np.int64), np.frombuffer(r["forward"], dtype=np.int64).reshape(-1, dim)) for r in rows]
                    best[dim].visit(blocks, np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]))
        for top in best.values():
            q, j = np.nonzero(top.score != LOW)
            yield pa.RecordBatch.from_arrays([pa.array(top.ids[q]), pa.array(top.vec[q, j]), pa.array(top.score[q, j])], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id `every` divides."""
    spark = rows.sparkSession
    vectors = written(integer_vectors(rows), "vectors")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    index = build_index(vectors, sample)
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = -(-queries.count() // QUERIES)
    found = spark.createDataFrame([], HITS)
    for i in range(n):
        batch = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).orderBy("vec_id").collect()
        by_dim = {}
        for dim in {len(r.v) for r in batch}:
            ids, q = np.array([r.vec_id for r in batch if len(r.v) == dim]), np.array([r.v for r in batch if len(r.v) == dim], dtype=np.int64)
            top = TopK(ids, q, np.full(len(ids), LOW), k)
            if own := [r for r in sample if len(r.v) == dim]:
                top.add(np.arange(len(ids)), np.array([r.vec_id for r in own]), np.array([r.v for r in own], dtype=np.int64))
            by_dim[dim] = ids, q, top.score[:, -1]
        found = found.unionByName(written(index.mapInArrow(_searcher(spark.sparkContext.broadcast(by_dim), k), HITS), "hits"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
