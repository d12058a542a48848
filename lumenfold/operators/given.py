"""Neighbours and spanning forests of given distances, without a shuffle of them.

The pairs are read twice. Each task keeps, of the pairs it sees, only those that can be among the k nearest of one of their ends
(first reading), or in the forest (second); what the tasks keep is put together. Nodes and their core distances are
broadcast, 16 bytes each: this is for NODES nodes at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE
from ..storage import written
from .mst import kruskal, spanning_forest

#: Most nodes; pairs that a task holds before it drops those it can do without.
NODES, HELD = 1 << 20, 1 << 19


def pairs_of(distances: DataFrame) -> DataFrame:
    """u, v, w of the pairs that count."""
    return distances.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("dist").cast("double").alias("w")).where("u <> v and w is not null")


def nodes_of(distances: DataFrame) -> np.ndarray | None:
    """The nodes in order; None if there are more than NODES."""
    pairs = pairs_of(distances)
    ends = written(pairs.select("u").distinct().union(pairs.select("v").distinct()).distinct(), "given-nodes", small=True)
    return np.sort(ends.toArrow().column("u").to_numpy()) if ends.count() <= NODES else None


class _Places:
    """Places of ids among the nodes: by the id itself where ids are dense."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.low = ids, int(ids[0])
        span = int(ids[-1]) - self.low + 1
        self.at = None
        if span <= 8 * len(ids):
            self.at = np.zeros(span, dtype=np.int64)
            self.at[ids - self.low] = np.arange(len(ids))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, x) if self.at is None else self.at[x - self.low]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "w"))


def _nearest(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest b of each a, ties to the smaller b, each pair once; writes the k-th distance of each a into bound."""
    by = np.lexsort((w, b, a))
    a, b, w = a[by], b[by], w[by]
    once = np.ones(len(a), dtype=bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, w = a[once], b[once], w[once]
    by = np.lexsort((b, w, a))
    a, b, w = a[by], b[by], w[by]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    bound[a[rank == k - 1]] = w[rank == k - 1]
    return a[rank < k], b[rank < k], w[rank < k]


def nearest_given(distances: DataFrame, nodes: np.ndarray, k: int) -> DataFrame:
    """u, v, dist, rank of the k nearest of each node among the given pairs."""
    shared = distances.sparkSession.sparkContext.broadcast(nodes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, bound = _Places(shared.value), np.full(len(shared.value), np.inf)
        held, n = [], 0
        for batch in batches:
            u, v, w = _columns(batch)
            a, b = places.of(u), places.of(v)
            for x, y in ((a, b), (b, a)):
                near = w <= bound[x]
                held.append((x[near], y[near], w[near]))
                n += len(held[-1][0])
            if n > max(HELD, 4 * k * len(bound)):
                held = [_nearest(*(np.concatenate(c) for c in zip(*held, strict=True)), k, bound)]
                n = len(held[0][0])
        if n:
            a, b, w = _nearest(*(np.concatenate(c) for c in zip(*held, strict=True)), k, bound)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[a]), pa.array(shared.value[b]), pa.array(w)], ["u", "v", "dist"])

    kept = pairs_of(distances).mapInArrow(keep, "u bigint, v bigint, dist double")
    once = kept.groupBy("u", "v").agg(F.min("dist").alias("dist"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("dist", "v"))).where(F.col("rank") <= k)


def forest_given(distances: DataFrame, nodes: np.ndarray, core: DataFrame, alpha: float = 1.0) -> DataFrame:
    """u, v, w of the spanning forest of the given pairs under mutual reachability; core: row_id, core of all nodes."""
    known = core.orderBy("row_id").toArrow()  # NODES at most
    shared = distances.sparkSession.sparkContext.broadcast((nodes, known.column("core").to_numpy()))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, far = shared.value
        places, top, held, n = _Places(ids), np.inf, [], 0

        def forest() -> pd.DataFrame:
            u, v, w = (np.concatenate(c) for c in zip(*held, strict=True))
            return kruskal(pd.DataFrame({"u": u, "v": v, "w": w}))

        for batch in batches:
            u, v, w = _columns(batch)
            # Where the edges held join all nodes, one heavier than each of them closes a cycle.
            w = w / alpha if alpha != 1.0 else w
            if top < np.inf:
                near = w <= top
                u, v, w = u[near], v[near], w[near]
            w = np.maximum(w, np.maximum(far[places.of(u)], far[places.of(v)]))
            near = w <= top
            if near.any():
                held.append((np.minimum(u, v)[near], np.maximum(u, v)[near], w[near]))
                n += len(held[-1][0])
            if n > max(HELD, 4 * len(ids)):
                left = forest()
                held, n = [tuple(left[c].to_numpy() for c in ("u", "v", "w"))], len(left)
                top = left["w"].max() if n == len(ids) - 1 else np.inf
        if n:
            yield pa.RecordBatch.from_pandas(forest().astype({"w": "float64"})[["u", "v", "w"]], preserve_index=False)

    return spanning_forest(written(pairs_of(distances).mapInArrow(reduce, EDGE), "given-forests"))
