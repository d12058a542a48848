"""Flat grouping by an epsilon neighbourhood, and its parameters.

Points are dealt into cells whose points all lie within epsilon of each other. A cell of min_samples points or more is
dense: all its points are core points of one component, and no pair of them is looked at. Only the few points of other
cells meet the points around them, in an equi-join on coarse cells of side epsilon. Neighbouring dense cells are joined
by a few points of each where those are near enough; where that leaves two in different components, all their points are
compared, until a pair is found.

This takes MAX_DIM dimensions at most (3 ** D coarse cells around a point). With more, pairs meet in cells of the first
MAX_DIM dimensions.
"""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import block_distance, box_bound, distance
from ..storage import ranked, spread, written
from .knn import core_distances, knn, matrix
from .mst import components

MAX_DIM = 4
#: Points of a coarse cell that one join key takes; points that stand for a dense cell in the first test.
SHARE, STAND = 4096, 8


def _around(cell: Column, dim: int) -> Column:
    """The cell and all that touch it."""
    moves = F.array(*(F.array(*map(F.lit, m)) for m in itertools.product((-1, 0, 1), repeat=dim)))
    return F.transform(moves, lambda m: F.zip_with(cell, m, lambda c, d: c + d))


def eps_pairs(points: DataFrame, eps: float) -> DataFrame:
    """u, v, dist of all pairs u < v at most eps apart (Euclidean)."""
    if eps <= 0:
        raise ValueError(f"eps: {eps}; more than 0")
    first = points.first()
    dim = min(MAX_DIM, len(first.features)) if first else 1
    home = F.array(*(F.floor(F.col("features")[i] / (eps * (1 + 1e-9))) for i in range(dim)))
    a = points.select(F.col("row_id").alias("u"), F.col("features").alias("x"), home.alias("cell"))
    b = points.select(F.col("row_id").alias("v"), F.col("features").alias("y"), F.explode(_around(home, dim)).alias("cell"))
    dist = distance(F.col("x"), F.col("y"))
    return a.join(b, "cell").where(F.col("u") < F.col("v")).select("u", "v", dist.alias("dist")).where(F.col("dist") <= eps)


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """row_id, component, is_core: core points have min_samples points within eps, themselves included; components join
    core points; another point joins the component of its nearest core (ties: the smaller id); noise has a null."""
    if min_samples < 1:
        raise ValueError(f"min_samples: {min_samples}; 1 or more")
    if eps <= 0:
        raise ValueError(f"eps: {eps}; more than 0")
    first = points.first()
    by = _by_cells if first and len(first.features) <= MAX_DIM else _by_pairs
    return by(points, eps, min_samples)


def _by_pairs(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    pairs = written(eps_pairs(points, eps), "eps-pairs")
    both = pairs.select("u", "v", "dist").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "dist"))
    degree = both.groupBy(F.col("u").alias("row_id")).agg(F.count("*").alias("n"))
    core = written(points.select("row_id").join(degree, "row_id", "left").select("row_id", (F.coalesce("n", F.lit(0)) + 1 >= min_samples).alias("is_core")), "cores")
    cu = core.where("is_core").select(F.col("row_id").alias("u"))
    cv = core.where("is_core").select(F.col("row_id").alias("v"))
    found = components(written(pairs.join(cu, "u").join(cv, "v").select("u", "v"), "core-links"))
    placed = core.join(found.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("component", F.when(F.col("is_core"), F.coalesce("component", "row_id")))
    placed = written(placed, "core-components")
    near = both.join(placed.where("is_core").select(F.col("row_id").alias("v"), "component"), "v").groupBy(F.col("u").alias("row_id")).agg(F.min(F.struct("dist", "v", "component"))["component"].alias("near"))
    return placed.join(near, "row_id", "left").select("row_id", F.coalesce("component", "near").alias("component"), "is_core")


def _by_cells(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    dim = len(points.first().features)
    parts = math.isqrt(dim) + 1
    # A little more than eps, so that rounding takes no two points eps apart beyond neighbouring coarse cells.
    side = eps * (1 + 1e-9) / parts
    cell = F.array(*(F.floor(F.col("features")[i] / side) for i in range(dim)))
    dealt = points.select("row_id", "features", cell.alias("cell")).withColumn("coarse", F.transform("cell", lambda c: F.floor(c / parts)))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("row_id").alias("home"))
    rows = written(dealt.join(sizes, "cell").withColumn("dense", F.col("n") >= min_samples).drop("n"), "eps-cells")
    shares = written(rows.groupBy("coarse").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "eps-coarse", small=True)

    # Points of cells that aren't dense, in each coarse cell around them, beside the points there.
    few = rows.where("not dense").select(F.col("row_id").alias("u"), F.col("features").alias("x"), F.explode(_around(F.col("coarse"), dim)).alias("coarse"))
    few = few.join(shares, "coarse").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    every = rows.select(F.col("row_id").alias("v"), F.col("features").alias("y"), "coarse", "home", "dense").join(shares, "coarse")
    every = every.withColumn("share", F.pmod(F.xxhash64("v"), "shares").cast("int")).drop("shares")
    dist = F.sqrt(sum(((F.col("x")[i] - F.col("y")[i]) * (F.col("x")[i] - F.col("y")[i]) for i in range(1, dim)), (F.col("x")[0] - F.col("y")[0]) * (F.col("x")[0] - F.col("y")[0])))
    met = spread(few, "coarse", "share").join(spread(every, "coarse", "share"), ["coarse", "share"]).withColumn("dist", dist).where(F.col("dist") <= eps)
    # Of a dense cell, whose points are all core points, the nearest one and the number suffice.
    met = written(met.groupBy("u", "home", F.when(~F.col("dense"), F.col("v")).alias("one")).agg(F.count("*").alias("n"), F.min(F.struct("dist", "v")).alias("e")), "eps-met")
    counted = met.groupBy(F.col("u").alias("row_id")).agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("row_id", F.lit(True).alias("many"))
    flagged = rows.join(counted, "row_id", "left").withColumn("is_core", F.col("dense") | F.col("many").isNotNull()).drop("many")
    # The core points of a cell are within eps of each other: they go by the least of them.
    nodes = flagged.where("is_core").groupBy("home").agg(F.min("row_id").alias("node"))
    flagged = written(flagged.join(nodes, "home", "left"), "eps-cores")
    us = flagged.where("not dense").select(F.col("row_id").alias("u"), F.col("is_core").alias("core_u"), F.when(F.col("is_core"), F.col("node")).alias("node_u"))
    vs = flagged.where("is_core").select(F.col("row_id").alias("v"), F.col("node").alias("node_v"))
    near = written(met.select("u", "e.dist", "e.v").join(vs, "v").join(us, "u"), "eps-near")
    links = near.where("core_u and node_u <> node_v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()

    dense = flagged.where("dense")
    order = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("row_id"), "row_id"))
    stands = dense.withColumn("i", order).where(F.col("i") <= STAND).groupBy("node", "cell", "coarse").agg(F.collect_list("features").alias("stand"))
    stands = written(stands, "eps-dense")
    a = stands.select(F.col("node").alias("u"), F.col("cell").alias("cell_u"), F.col("stand").alias("stand_u"), F.explode(_around(F.col("coarse"), dim)).alias("coarse"))
    gap = F.aggregate(F.zip_with("cell_u", "cell_v", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, g: s + g * g)
    pairs = a.join(stands.select(F.col("node").alias("v"), F.col("cell").alias("cell_v"), F.col("stand").alias("stand_v"), "coarse"), "coarse").where((F.col("u") < F.col("v")) & (gap <= parts * parts))
    touch = F.exists("stand_u", lambda x: F.exists("stand_v", lambda y: distance(x, y) <= eps))
    pairs = written(pairs.select("u", "v", touch.alias("touch")), "eps-dense-pairs", small=True)
    links = written(links.unionByName(pairs.where("touch").select("u", "v")), "eps-links", small=True)

    found = components(links)
    left = pairs.where("not touch")
    for end in ("u", "v"):
        left = left.join(found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    left = written(left.where("cu <> cv").select("u", "v"), "eps-open", small=True)
    if not left.isEmpty():
        own = dense.select("node", "features")
        x = spread(left.join(own, F.col("u") == F.col("node")).select("u", "v", "features").toDF("u", "v", "features"), "u", "v")
        y = spread(left.join(own, F.col("v") == F.col("node")).select("u", "v", "features").toDF("u", "v", "features"), "u", "v")

        def linked(left_: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            a, b = matrix(left_["features"]), matrix(right["features"])
            bounds = lambda q, box: box_bound(q, box.min(axis=0, keepdims=True), box.max(axis=0, keepdims=True), "euclidean")[:, 0]
            a, b = a[bounds(a, b) <= eps], b[bounds(b, a) <= eps]
            hit = any((block_distance(a[i : i + 512], b[j : j + 2048]) <= eps).any() for i in range(0, len(a), 512) for j in range(0, len(b), 2048))
            return left_[["u", "v"]].head(1) if hit else left_[["u", "v"]].head(0)

        more = written(x.groupBy("u", "v").cogroup(y.groupBy("u", "v")).applyInPandas(linked, "u bigint, v bigint"), "eps-more", small=True)
        found = components(written(links.unionByName(more), "eps-links", small=True))
    placed = flagged.select("row_id", "is_core", F.when(F.col("is_core"), F.col("node")).alias("node"))
    border = near.where("not core_u").groupBy(F.col("u").alias("row_id")).agg(F.min(F.struct("dist", "v", "node_v"))["node_v"].alias("near"))
    placed = placed.join(border, "row_id", "left").select("row_id", "is_core", F.coalesce("node", "near").alias("node"))
    return placed.join(found, "node", "left").select("row_id", F.coalesce("component", "node").alias("component"), "is_core")


def numbered(grouped: DataFrame) -> DataFrame:
    """row_id, label: components numbered from 0 in order of their smallest id, noise -1."""
    seen = ranked(grouped.where("component is not null").select("component").distinct(), ["component"], "label")
    return grouped.join(seen, "component", "left").select("row_id", F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("label"))


def elbow(core: DataFrame) -> DataFrame:
    """eps, index, n: the sorted core distance farthest from the chord between the first and the last; the first such."""
    rows = written(ranked(core.select("core", "row_id"), ["core", "row_id"], "i").select("core", "i"), "core-ranked")
    ends = rows.agg(F.count("*").alias("n"), F.min("core").alias("y0"), F.max("core").alias("y1"))
    gap = F.abs((F.col("n") - 1) * (F.col("y0") - F.col("core")) + F.col("i") * (F.col("y1") - F.col("y0")))
    best = rows.crossJoin(F.broadcast(ends)).agg(F.max(F.struct(F.round(gap, 9).alias("gap"), (-F.col("i")).alias("j"), "core")).alias("s"), F.max("n").alias("n"))
    return best.select(F.col("s.core").alias("eps"), (-F.col("s.j")).cast("long").alias("index"), "n")


def estimated_eps(points: DataFrame, min_samples: int) -> DataFrame:
    """eps at the elbow of the min_samples-th neighbour distances (the point itself counts as the first)."""
    return elbow(core_distances(knn(points, max(1, min_samples - 1)), min_samples, include_self=True))


def tried_min_samples(dim: int) -> range:
    """The k from D + 1 to 2 D."""
    return range(dim + 1, 2 * dim + 1)


def choose_min_samples(points: DataFrame | int, fit) -> tuple[int, list[tuple[int, float]]]:
    """Of k from D + 1 to 2 D, that with the highest mean stability of selected clusters (the first of equals).

    points: a table of them, or D. fit: k -> clusters (stability, selected) as `hierarchy.clusters` gives them.
    """
    dim = points if isinstance(points, int) else len(points.first().features)
    tried = [(k, fit(k).where("selected").agg(F.coalesce(F.avg("stability"), F.lit(0.0)).alias("m")).first().m) for k in tried_min_samples(dim)]
    return max(tried, key=lambda x: (x[1], -x[0]))[0], tried
