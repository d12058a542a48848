"""Exact k nearest neighbours, core distances and mutual reachability.

Points are dealt into cells of a k-d partition of a bounded sample, and each large cell into parts by medians of its own.
Each part finds neighbours among its own points, which bounds the k-th distance; a point then goes only to the parts
whose bounding box, and whose ball around the mean, could hold something nearer. No pair of points leaves a task but
those among the k nearest there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, ball_bound, block_distance, box_bound, boxes_bound, metric_name
from ..schema import KNN
from ..storage import spread, written

#: Points of a part; most cells; points sampled to place the cells; points of a cell that one task splits.
PART, CELLS, SAMPLE, SPLIT = 2048, 4096, 16_384, 1 << 20
#: Bytes of all parts' boxes, which are broadcast: with more points or dimensions, parts become larger.
BOX_BYTES = 64 << 20
#: Distances held at once.
CHUNK = 1 << 18
#: Metrics that are 0 between equal points, and otherwise only by rounding.
PLAIN = ("manhattan", "euclidean", "chebyshev", "minkowski", "seuclidean")


def _tree(x: np.ndarray, cells: int) -> list | None:
    """Nested (axis, value, low, high) splits at medians; a leaf is None."""
    if cells <= 1 or len(x) < 2:
        return None
    axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
    value = float(np.median(x[:, axis]))
    left = x[:, axis] < value
    if not left.any() or left.all():
        return None
    return [axis, value, _tree(x[left], cells // 2), _tree(x[~left], cells - cells // 2)]


def _cell(tree, x: np.ndarray, out: np.ndarray, rows: np.ndarray, at: int = 0) -> int:
    """Number the leaves from `at`; write each row's leaf; the next number."""
    if tree is None:
        out[rows] = at
        return at + 1
    axis, value, low, high = tree
    left = x[rows, axis] < value
    return _cell(high, x, out, rows[~left], _cell(low, x, out, rows[left], at))


def matrix(column) -> np.ndarray:
    """A features column as a matrix."""
    return np.array(list(column), dtype=float).reshape(len(column), -1)


def _to_cells(tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            if batch.num_rows:
                _cell(tree.value, matrix(batch.column("features").to_pylist()), out, np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "cell"])

    return run


def _halved(x: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rows dealt at the medians of their widest component until each share has `size` at most; equal points in turn."""
    if len(rows) <= size:
        yield rows
        return
    own = x[rows]
    by = np.argsort(own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))], kind="stable")
    yield from _halved(x, rows[by[: len(by) // 2]], size)
    yield from _halved(x, rows[by[len(by) // 2 :]], size)


def parted(points: DataFrame, part: int = PART) -> DataFrame:
    """points (row_id, features, ...) with a column `part`: parts hold `part` points at most (more only where all boxes would
    take more than BOX_BYTES), near each other where they differ."""
    n, dim = points.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(1))).first()
    part = max(part, -(-n * 24 * dim // BOX_BYTES))
    if n <= part:
        return points.withColumn("part", F.lit("0"))
    sample = points.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE).select("features").toArrow()
    tree = points.sparkSession.sparkContext.broadcast(_tree(matrix(sample.column("features").to_pylist()), min(CELLS, -(-n // part))))
    names = points.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    cells = written(points.mapInArrow(_to_cells(tree), f"{fields}, cell bigint"), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > part).withColumn("shares", F.ceil(F.col("n") / SPLIT))
    sizes = F.broadcast(sizes)  # CELLS rows at most

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", ignore_index=True)
        at = np.empty(len(pdf), dtype=object)
        for i, rows in enumerate(_halved(matrix(pdf["features"]), np.arange(len(pdf)), part)):
            at[rows] = f"{pdf['part'].iloc[0]}-{i}"
        return pdf.assign(part=at)

    cells = cells.join(sizes, "cell", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("row_id"), "shares"), F.lit(0)))
    small = cells.where("n is null").withColumn("part", F.col("cell").cast("string")).select(*names, "part")
    large = cells.where("n is not null").withColumn("part", F.concat_ws("/", "cell", "share")).select(*names, "part")
    return small.unionByName(large.groupBy("part").applyInPandas(split, f"{fields}, part string"))


@dataclass
class Boxes:
    """What is known of each part without its points: bounds of its box, its mean and the farthest distance from it."""

    names: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    metric: Metric
    p: float
    weights: Sequence[float] | None

    def bound(self, x: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """For each point and part, a distance that no point of the part undercuts."""
        box = box_bound(x, self.low[at], self.high[at], self.metric, self.p, self.weights)
        return np.maximum(box, ball_bound(x, self.centre[at], self.radius[at], self.metric, self.p, self.weights))

    def apart(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For a box and each part, a distance that no two points undercut."""
        return boxes_bound(low, high, self.low, self.high, self.metric, self.p, self.weights)


def boxes(dealt: DataFrame, metric: Metric = "euclidean", p: float = 2.0, weights: Sequence[float] | None = None) -> Boxes:
    """Of all parts; some 3 vectors for each `PART` points, BOX_BYTES at most, come to the driver."""
    plain = metric if isinstance(metric, str) and metric in PLAIN else "euclidean"

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf["features"])
        centre = x.mean(axis=0)
        far = float(block_distance(x, centre[None, :], plain, p, weights if plain == metric else None).max())
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "low": [x.min(axis=0)], "high": [x.max(axis=0)], "centre": [centre], "radius": [far]})

    got = dealt.select("part", "features").groupBy("part").applyInPandas(summary, "part string, low array<double>, high array<double>, centre array<double>, radius double").orderBy("part").toArrow()
    cols = [matrix(got.column(c).to_pylist()) for c in ("low", "high", "centre")]
    return Boxes(np.array(got.column("part").to_pylist(), dtype=object), *cols, np.array(got.column("radius").to_pylist(), dtype=float), metric, p, weights)


def nearest(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, metric: Metric, p: float, weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of own, v, dist) of the k nearest of `ids` for each of `own`, ties to the smaller id; a point isn't its own neighbour."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    step, parts = max(1, CHUNK // max(1, len(ids))), []
    for i in range(0, len(own), step):
        d = block_distance(q[i : i + step], x, metric, p, weights)
        d[np.isnan(d)] = np.inf
        d[own[i : i + step, None] == ids[None, :]] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
        r, c = np.nonzero((d <= kth) & np.isfinite(d))
        dist = d[r, c]
        by = np.lexsort((c, dist, r))
        r, c, dist = r[by], c[by], dist[by]
        ok = np.arange(len(r)) - np.searchsorted(r, r) < k
        parts.append((i + r[ok], ids[c[ok]], dist[ok]))
    return tuple(np.concatenate(a) for a in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), ids[:0], np.empty(0))


@dataclass
class Dealt:
    """Points in parts, written: table (row_id, features, part), their number, and what is known of the parts."""

    table: DataFrame
    n: int
    known: Boxes


def deal(points: DataFrame, metric: Metric = "euclidean", p: float = 2.0, weights: Sequence[float] | None = None, part: int = PART) -> Dealt:
    """Points (row_id, features) in parts, once for all that works on parts."""
    table = written(spread(parted(points.select("row_id", "features"), part), "part"), "dealt")
    return Dealt(table, table.count(), boxes(table, metric_name(metric), p, weights))


def knn(points: DataFrame | Dealt, k: int, metric: Metric = "euclidean", p: float = 2.0, weights: Sequence[float] | None = None, part: int = PART) -> DataFrame:
    """u, v, dist, rank (1 to k) for points (row_id, features); pairs without a distance (dso at 0) are left out.

    Raises if there are no more than k points.
    """
    metric = metric_name(metric)
    if k < 1:
        raise ValueError(f"k: {k}; 1 or more")
    dealt = points if isinstance(points, Dealt) else deal(points, metric, p, weights, part)
    if dealt.n <= k:
        raise ValueError(f"{dealt.n} points; more than {k} are needed for {k} neighbours")

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        """Each point with its neighbours in the part, and the distance beyond which nothing can be among the k nearest."""
        ids, x = pdf["row_id"].to_numpy(), matrix(pdf["features"])
        r, v, dist = nearest(ids, x, ids, x, k, metric, p, weights)
        cuts = np.searchsorted(r, np.arange(1, len(ids)))
        found, far = np.split(v, cuts), np.split(dist, cuts)
        return pdf[["row_id", "features", "part"]].assign(reach=[d[-1] if len(d) == k else np.inf for d in far], v=found, dist=far)

    inner = written(spread(dealt.table, "part").groupBy("part").applyInPandas(local, "row_id bigint, features array<double>, part string, reach double, v array<bigint>, dist array<double>"), "knn-inside")
    pair = F.posexplode(F.arrays_zip("v", "dist")).alias("i", "e")
    inside = inner.select(F.col("row_id").alias("u"), pair).select("u", "e.v", "e.dist", (F.col("i") + 1).alias("rank"))
    if len(dealt.known.names) == 1:
        return inside
    shared = dealt.table.sparkSession.sparkContext.broadcast(dealt.known)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each point for each other part that could hold something nearer; the rows of a part come together."""
        known: Boxes = shared.value
        for pdf in frames:
            for name, own in pdf.groupby("part", sort=False):
                x, reach = matrix(own["features"]), own["reach"].to_numpy()
                near = np.flatnonzero((known.apart(x.min(axis=0), x.max(axis=0)) <= reach.max()) & (known.names != name))
                r, c = np.nonzero(known.bound(x, near) <= reach[:, None])
                yield pd.DataFrame({"row_id": own["row_id"].to_numpy()[r], "features": own["features"].to_numpy()[r], "target": known.names[near[c]]})

    routed = inner.select("row_id", "features", "part", "reach").mapInPandas(route, "row_id bigint, features array<double>, target string")

    def visit(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(own):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        ids = queries["row_id"].to_numpy()
        r, v, dist = nearest(own["row_id"].to_numpy(), matrix(own["features"]), ids, matrix(queries["features"]), k, metric, p, weights)
        return pd.DataFrame({"u": ids[r], "v": v, "dist": dist})

    own = spread(dealt.table, "part")
    outside = spread(routed, "target").groupBy("target").cogroup(own.groupBy("part")).applyInPandas(visit, "u bigint, v bigint, dist double")
    ranked = inside.drop("rank").unionByName(outside).withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("dist", "v")))
    return ranked.where(F.col("rank") <= k).select(*(x.split(" ")[0] for x in KNN.split(", ")))


def core_distances(neighbours: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """row_id, core: distance of the k-th neighbour; a point counts as its own first with include_self."""
    rank = k - 1 if include_self else k
    return neighbours.groupBy(F.col("u").alias("row_id")).agg(F.coalesce(F.max(F.when(F.col("rank") <= rank, F.col("dist"))), F.lit(0.0)).alias("core"))


def core_by_pairs(points: DataFrame, k: int, metric: Metric = "euclidean", p: float = 2.0, weights: Sequence[float] | None = None, block: int = 4096) -> DataFrame:
    """row_id, core: the distance of the k-th other point, from all pairs of points, block by block: quadratic, for checks. A task
    holds two blocks, and hands on the k least distances of each point."""
    metric = metric_name(metric)
    blocks = max(1, -(-points.count() // block))
    rows = points.select("row_id", "features").withColumn("a", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = spread(rows.withColumn("b", every), "a", "b")
    right = spread(rows.withColumnRenamed("a", "b").withColumn("a", every), "a", "b")

    def least(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ids, q, others = queries["row_id"].to_numpy(), matrix(queries["features"]) if len(queries) else None, own["row_id"].to_numpy()
        out = []
        if len(ids) and len(others):
            x, step = matrix(own["features"]), max(1, CHUNK // len(others))
            for i in range(0, len(ids), step):
                d = block_distance(q[i : i + step], x, metric, p, weights)
                d[np.isnan(d) | (ids[i : i + step, None] == others[None, :])] = np.inf
                out += list(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d)
        return pd.DataFrame({"row_id": ids[: len(out)], "near": out})

    near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(least, "row_id bigint, near array<double>")
    kth = F.get(F.array_sort(F.filter(F.flatten(F.collect_list("near")), lambda d: d < float("inf"))), F.lit(k - 1))
    return near.groupBy("row_id").agg(kth.alias("core"))


def mutual_reachability(neighbours: DataFrame, core: DataFrame, alpha: float = 1.0) -> DataFrame:
    """u, v, w: the largest of dist / alpha and both core distances."""
    cu, cv = core.select(F.col("row_id").alias("u"), F.col("core").alias("cu")), core.select(F.col("row_id").alias("v"), F.col("core").alias("cv"))
    return neighbours.join(cu, "u").join(cv, "v").select("u", "v", F.greatest(F.col("dist") / alpha, "cu", "cv").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, u < v, with its least weight."""
    return edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))


def compare_edges(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """n, missing, differing: how two edge tables (u, v, w) compare."""
    both = a.select("u", "v", F.col("w").alias("wa")).join(b.select("u", "v", F.col("w").alias("wb")), ["u", "v"], "full")
    absent = F.col("wa").isNull() | F.col("wb").isNull()
    return both.agg(F.count("*").alias("n"), F.coalesce(F.sum(absent.cast("long")), F.lit(0)).alias("missing"), F.coalesce(F.sum((F.abs(F.col("wa") - F.col("wb")) > tolerance).cast("long")), F.lit(0)).alias("differing"))


def compare_core(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """n, missing, differing: how two tables of core distances (row_id, core) compare."""
    edge = lambda t: t.select(F.col("row_id").alias("u"), F.col("row_id").alias("v"), F.col("core").alias("w"))
    return compare_edges(edge(a), edge(b), tolerance)
