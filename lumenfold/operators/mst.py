"""Minimum spanning forests.

Edges are ordered by (w, u, v), so that the forest is unique. An edge that a part of the edges can do without is not in
the forest of all (cycle property): parts are reduced by themselves, and what is left is reduced together. A complete
graph over points is never written out: parts of points that lie near each other have trees of their own, and only
neighbouring parts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, block_distance, box_bound, metric_name
from ..schema import EDGE
from ..storage import release, spread, written
from .components import connected_components
from .knn import PART, Boxes, Dealt, deal, matrix

#: Edges that one task takes.
EDGES = 1_000_000


class Sets:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def first_edges(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges between 0 to n - 1 join what no earlier ones join: by rounds of each component's first edge."""
    m, label = len(a), np.arange(n)
    taken, left = np.zeros(m, dtype=bool), np.arange(m)
    while True:
        x, y = label[a[left]], label[b[left]]
        open_ = x != y
        left, x, y = left[open_], x[open_], y[open_]
        if not len(left):
            return taken
        # Of several values for one place the last is kept: from the end, that is the first edge.
        first, other = np.full(n, m), np.full(n, m)
        first[x[::-1]], other[y[::-1]] = left[::-1], left[::-1]
        first = np.minimum(first, other)
        root = np.flatnonzero(first < m)
        edge = first[root]
        taken[edge] = True
        up, p, q = np.arange(n), label[a[edge]], label[b[edge]]
        up[root] = np.where(p == root, q, p)
        top = root[(up[up[root]] == root) & (root < up[root])]  # two that choose the same edge
        up[top] = top
        while not np.array_equal(over := up[up], up):
            up = over
        label = up[label]


def kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Forest of the edges u, v, w."""
    pdf = pdf.sort_values(["w", "u", "v"], kind="stable")
    ids, ends = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    return pdf[first_edges(ends[:, 0], ends[:, 1], len(ids))]


def _each_part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "w": pd.Series(dtype="float64")})
    for pdf in frames:
        held = pd.concat([held, pdf], ignore_index=True) if len(held) else pdf
        if len(held) > EDGES:
            held = kruskal(held)
    if len(held):
        yield kruskal(held)


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, ends = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    sets = Sets(len(ids))
    for a, b in ends.reshape(-1, 2).tolist():
        sets.join(a, b)
    return pd.DataFrame({"node": ids, "component": ids[[sets.find(i) for i in range(len(ids))]]}, dtype="int64")


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """node, component: by one task up to `most` edges, by star steps over the cluster beyond."""
    pairs = edges.select("u", "v")
    if pairs.count() > most:
        return connected_components(pairs)
    return pairs.groupBy().applyInPandas(_components, "node bigint, component bigint")


def spanning_forest(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """u, v, w of the minimum spanning forest of edges (u, v, w)."""
    now = written(edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w")), "edges")
    n = now.count()
    while n > most:
        # Ranges of u keep neighbours together, so that parts find cycles.
        reduced = written(now.repartitionByRange(-(-n // most), "u", "v").mapInPandas(_each_part, EDGE), "edges")
        left = reduced.count()
        release(now)
        if left > 0.8 * n:
            return boruvka(reduced)
        now, n = reduced, left
    return now.groupBy().applyInPandas(kruskal, EDGE)  # at most `most` edges


def boruvka(edges: DataFrame) -> DataFrame:
    """The same forest by rounds of each component's cheapest edge; for edge tables that parts don't reduce."""
    now = written(edges.where("u <> v").select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "boruvka")
    tree = None
    while not now.isEmpty():
        ends = now.select(F.col("cu").alias("c"), "w", "u", "v").unionByName(now.select(F.col("cv").alias("c"), "w", "u", "v"))
        cheapest = ends.groupBy("c").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("e.u", "e.v", "e.w").distinct()
        before, old = now, tree
        tree = written(cheapest if tree is None else tree.unionByName(cheapest), "boruvka-tree")
        placed = written(components(tree), "boruvka-components")
        for end in ("u", "v"):
            now = now.join(placed.select(F.col("node").alias(end), F.col("component").alias(f"n{end}")), end, "left")
        now = written(now.select("u", "v", "w", F.coalesce("nu", "u").alias("cu"), F.coalesce("nv", "v").alias("cv")).where("cu <> cv"), "boruvka")
        release(before, old, placed)
    return tree if tree is not None else edges.select("u", "v", "w").limit(0)


class _Row:
    """Distances from one point to many whose components are held as columns, with the sums of `block_distance`."""

    def __init__(self, x: np.ndarray, metric: Metric, p: float, weights):
        self.metric, self.p, self.weights = metric, p, weights
        self.plain = metric == "euclidean" and weights is None
        self.cols = np.ascontiguousarray(x.T)

    def to(self, at: np.ndarray, n: int) -> np.ndarray:
        if not self.plain:
            d = block_distance(at[None, :], self.cols[:, :n].T, self.metric, self.p, self.weights)[0]
            return np.where(np.isnan(d), np.inf, d)
        out = np.zeros(n)
        for x, col in zip(at, self.cols, strict=True):
            d = x - col[:n]
            out += d * d
        return np.sqrt(out, out=out)

    def move(self, i: int, j: int) -> None:
        self.cols[:, i] = self.cols[:, j]


def prim(ids: np.ndarray, x: np.ndarray, core: np.ndarray, metric: Metric = "euclidean", alpha: float = 1.0, p: float = 2.0, weights=None, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tree of the complete mutual-reachability graph of some points (ids rising), in memory linear in them; ties by (w, u, v).

    For each point but the start, in order of joining: its place, the place it is joined to, the weight, and the largest
    weight on its way to the start.
    """
    m = len(ids) - 1
    rest = np.delete(np.arange(m + 1), start)
    row, far = _Row(x[rest], metric, p, weights), core[rest].copy()
    best, source = np.full(m, np.inf), np.full(m, start)
    joined, to, weight, worst = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m), np.zeros(m + 1)
    at = start
    for i in range(m):
        n = m - i
        d = row.to(x[at], n)
        if alpha != 1.0:
            d /= alpha
        np.maximum(d, far[:n], out=d)
        np.maximum(d, core[at], out=d)
        # Of two equal edges to the same point, that from the smaller place has the smaller ends.
        closer = d < best[:n]
        same = d == best[:n]
        if same.any():
            closer |= same & (at < source[:n])
        best[:n][closer] = d[closer]
        source[:n][closer] = at
        k = int(np.argmin(best[:n]))
        low = np.flatnonzero(best[:n] == best[k])
        if len(low) > 1:
            a, b = rest[low], source[low]
            k = int(low[np.lexsort((np.maximum(a, b), np.minimum(a, b)))[0]])
        at, src = int(rest[k]), int(source[k])
        joined[i], to[i], weight[i] = at, src, best[k]
        worst[at] = max(worst[src], best[k])
        last = n - 1
        rest[k], far[k], best[k], source[k] = rest[last], far[last], best[last], source[last]
        row.move(k, last)
    return joined, to, weight, worst


def _edges(ids: np.ndarray, joined: np.ndarray, to: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": ids[np.minimum(joined, to)], "v": ids[np.maximum(joined, to)], "w": w})


#: A part's points with the edge of the part's tree by which each joins, and the largest weight on its way to the part's
#: start, which is the point of the least core distance and has the largest of all weights as `most`.
_GROWN = "row_id bigint, features array<double>, core double, part string, u bigint, v bigint, w double, worst double, most double"


@dataclass
class _Reach:
    """The parts' boxes, and how far apart two parts can be while an edge between them may still be in the tree.

    A path from a point to its part's start, on to the other part's start and to a point there joins the two; an edge that is
    heavier than everything on such a path isn't in the tree. Parts are kept in an order in which the heaviest step
    between two of them is the heaviest `step` between their places.
    """

    known: Boxes
    core: np.ndarray
    worst: np.ndarray
    place: np.ndarray
    step: np.ndarray
    alpha: float

    def between(self, i: int) -> np.ndarray:
        """The heaviest step on the way from part i to each part."""
        at = int(self.place[i])
        right = np.maximum.accumulate(np.concatenate([[0.0], self.step[at:]]))
        left = np.maximum.accumulate(np.concatenate([[0.0], self.step[:at][::-1]]))[::-1]
        return np.concatenate([left[:-1], right])[self.place]

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Later parts that an edge from part i may lead to, and the heaviest step on the way."""
        way = self.between(i)
        near = np.maximum(self.known.apart(self.known.low[i], self.known.high[i]) / self.alpha, np.maximum(self.core[i], self.core))
        j = np.flatnonzero(near <= np.maximum(way, np.maximum(self.worst[i], self.worst)))
        return j[j > i], way[j[j > i]]


def _ordered_parts(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of n nodes and the weights between neighbours, so that the largest weight between two places is the
    heaviest edge on the lightest way between the nodes: merged groups stand beside each other."""
    sets, line = Sets(n), {i: ([i], []) for i in range(n)}
    for k in np.argsort(w, kind="stable").tolist():
        x, y = sorted((sets.find(int(a[k])), sets.find(int(b[k]))))
        if x != y:
            sets.join(x, y)
            (p, s), (q, t) = line.pop(x), line.pop(y)
            if len(p) < len(q):
                line[x] = (q + p, t + [w[k]] + s)
            else:
                p += q
                s += [w[k], *t]
                line[x] = (p, s)
    order, steps = next(iter(line.values()))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return place, np.array(steps, dtype=float)


def complete_tree(points: DataFrame | Dealt, core: DataFrame, metric: Metric = "euclidean", alpha: float = 1.0, p: float = 2.0, weights: Sequence[float] | None = None, near: DataFrame | None = None, block: int = PART) -> DataFrame:
    """u, v, w of the minimum spanning tree of all points (row_id, features) under mutual reachability.

    Points are dealt into parts near each other, and each part's own tree is grown. An edge between two parts can only be
    in the tree if nothing lighter joins its ends by way of the parts' own trees, the neighbours `near` (u, v, dist) and
    the parts' starts: so only neighbouring parts are compared, and there only the points that near. With a metric that
    boxes don't bound, all parts are.
    """
    metric = metric_name(metric)
    dealt = points if isinstance(points, Dealt) else deal(points, metric, p, weights, block)
    known = dealt.known

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", ignore_index=True)
        ids, x, c = pdf["row_id"].to_numpy(), matrix(pdf["features"]), pdf["core"].to_numpy()
        start = int(np.argmin(c))
        joined, to, w, worst = prim(ids, x, c, metric, alpha, p, weights, start)
        out = pdf[["row_id", "features", "core", "part"]].assign(u=pd.array([pd.NA] * len(ids), "Int64"), v=pd.array([pd.NA] * len(ids), "Int64"), w=np.nan, worst=worst, most=np.nan)
        edges = _edges(ids, joined, to, w)
        for name in ("u", "v", "w"):
            out.loc[joined, name] = edges[name].to_numpy()
        out.loc[start, "most"] = worst.max()
        return out

    grown = written(spread(dealt.table.join(core, "row_id").select("row_id", "features", "core", "part"), "part").groupBy("part").applyInPandas(grow, _GROWN), "grown")
    own = grown.where("u is not null").select("u", "v", "w")
    n = len(known.names)
    if n < 2:
        return own
    spark = dealt.table.sparkSession
    starts = grown.where("u is null").select("part", "features", "core", "most").orderBy("part").toArrow()
    low_core, worst = starts.column("core").to_numpy(), starts.column("most").to_numpy()
    # Ways between parts: from start to start, and over neighbours of two parts.
    at = {name: i for i, name in enumerate(known.names)}
    joined, to, w, _ = prim(np.arange(n), matrix(starts.column("features").to_pylist()), low_core, metric, alpha, p, weights)
    a, b, w = [joined], [to], [w]
    if near is not None:
        end = lambda s: grown.select(F.col("row_id").alias(s), F.col("part").alias(f"part_{s}"), F.col("core").alias(f"core_{s}"), F.col("worst").alias(f"worst_{s}"))
        across = near.select("u", "v", "dist").join(end("u"), "u").join(end("v"), "v").where("part_u <> part_v")
        across = across.groupBy("part_u", "part_v").agg(F.min(F.greatest(F.col("dist") / alpha, "core_u", "core_v", "worst_u", "worst_v")).alias("w")).toArrow()
        a.append(np.array([at[x] for x in across.column("part_u").to_pylist()], dtype=np.int64))
        b.append(np.array([at[x] for x in across.column("part_v").to_pylist()], dtype=np.int64))
        w.append(across.column("w").to_numpy())
    place, step = _ordered_parts(n, np.concatenate(a), np.concatenate(b), np.concatenate(w))
    reach = spark.sparkContext.broadcast(_Reach(known, low_core, worst, place, step, alpha))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in pdf["id"]:
                j, way = reach.value.partners(int(i))
                yield pd.DataFrame({"a": reach.value.known.names[i], "b": reach.value.known.names[j], "way": way})

    met = written(spark.range(n).mapInPandas(pairs, "a string, b string, way double"), "part-pairs", small=True)
    rows = grown.select("row_id", "features", "core", "part", "worst")
    columns = ["row_id", "features", "core", "worst", "way", "a", "b"]
    left, right = (spread(rows.join(met, F.col("part") == F.col(side)).select(*columns).toDF(*columns), "a", "b") for side in ("a", "b"))

    def cross(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        """Edges between two parts, among the points that are near enough to the other part."""
        if not len(x) or not len(y):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "w": pd.Series(dtype="float64")})
        way, sides = x["way"].iloc[0], []
        for pdf, other in ((x, y), (y, x)):
            q, box = matrix(pdf["features"]), matrix(other["features"])
            gap = box_bound(q, box.min(axis=0, keepdims=True), box.max(axis=0, keepdims=True), metric, p, weights)[:, 0] / alpha
            sides.append((q, np.maximum(gap, pdf["core"].to_numpy()), np.maximum(pdf["worst"].to_numpy(), way)))
        tops = [reach_[gap <= reach_].max(initial=way) for _, gap, reach_ in sides]
        keep = [gap <= np.maximum(own_reach, top) for (_, gap, own_reach), top in zip(sides, tops[::-1], strict=True)]
        ids = np.concatenate([pdf["row_id"].to_numpy()[k] for pdf, k in zip((x, y), keep, strict=True)])
        side = np.repeat([0, 1], [k.sum() for k in keep])
        by = np.argsort(ids, kind="stable")
        ids, side = ids[by], side[by]
        q = np.concatenate([s[0][k] for s, k in zip(sides, keep, strict=True)])[by]
        c = np.concatenate([pdf["core"].to_numpy()[k] for pdf, k in zip((x, y), keep, strict=True)])[by]
        if not (side == 0).any() or not (side == 1).any():
            return pd.DataFrame({"u": ids[:0], "v": ids[:0], "w": c[:0]})
        joined, to, w, _ = prim(ids, q, c, metric, alpha, p, weights)
        crossing = side[joined] != side[to]
        return _edges(ids, joined[crossing], to[crossing], w[crossing])

    between = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(cross, EDGE)
    # The merge tree takes the tree's edges in one task in any case.
    return spanning_forest(own.unionByName(between), max(EDGES, 4 * dealt.n))


def verify_forest(edges: DataFrame, forest: DataFrame) -> bool:
    """Whether the forest joins what the edges join, without a cycle."""
    a, b = components(edges), components(forest)
    same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    counted = b.agg(F.count("*").alias("n"), F.countDistinct("component").alias("c")).first()
    return same and forest.count() == counted.n - counted.c


def forest_components(forest: DataFrame, nodes: int | None = None) -> DataFrame:
    """component (its smallest node), u, v, w. A forest of all but one as many edges as nodes is one tree."""
    n, low = forest.agg(F.count("*"), F.min(F.least("u", "v"))).first()
    if n and n + 1 == nodes:
        return forest.select(F.lit(low).cast("long").alias("component"), "u", "v", "w")
    placed = components(forest)
    return forest.join(placed.withColumnRenamed("node", "u"), "u").select("component", "u", "v", "w")


def ordered(forest: DataFrame) -> DataFrame:
    """With the place of each edge in its component's order (w, u, v)."""
    return forest.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy("w", "u", "v")))
