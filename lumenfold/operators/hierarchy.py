"""Merge trees of spanning forests, condensed trees, cluster selection, labels and strengths.

A component's merges follow one another, so one task works through the edges of a component; everything after that
is on the condensed tree. Two profiles differ as follows.

standard: the distance of a node's own split makes its lambda; stability counts from a cluster's birth; the root is
selected only with allow_single_cluster.
native: the distance at which a node merged into its parent makes its lambda (0 for a root), in single precision;
stability has no birth term; roots can be selected.

A zero distance has an infinite lambda. Internal nodes are numbered from `first` on within a component, in order of
merging; clusters likewise, the root first. Left is the side with the smaller least node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLUSTER, CONDENSED, HIERARCHY
from ..storage import ranked, spread, written
from .mst import Sets

METHODS, PROFILES = ("eom", "leaf"), ("standard", "native")
#: Clusters of a component that one task climbs from, and most such tasks; pairs of clusters handed on at a time.
SHARE, SHARES, PAIRS = 1024, 64, 1 << 16


@dataclass(frozen=True)
class Selection:
    """How clusters are chosen; epsilon is a distance, 0 for none."""

    min_cluster_size: int = 5
    method: str = "eom"
    profile: str = "standard"
    epsilon: float = 0.0
    allow_single_cluster: bool = False
    max_cluster_size: int | None = None

    def __post_init__(self):
        if self.min_cluster_size < 2:
            raise ValueError(f"min_cluster_size: {self.min_cluster_size}; 2 or more")
        if self.method not in METHODS or self.profile not in PROFILES:
            raise ValueError(f"method: {self.method!r} of {METHODS}, profile: {self.profile!r} of {PROFILES}")
        if self.epsilon < 0 or (self.max_cluster_size is not None and self.max_cluster_size < 1):
            raise ValueError("epsilon: 0 or more; max_cluster_size: 1 or more")


@dataclass
class Tree:
    """Merge tree of one component: leaves 0 to n - 1 stand for ids; node n + i is the i-th merge. A leaf of a size above 1 is
    several points at one place, which goes by the smallest of their ids."""

    ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    dist: np.ndarray
    size: np.ndarray


def linkage(u: np.ndarray, v: np.ndarray, w: np.ndarray, ids: np.ndarray | None = None, held: np.ndarray | int = 1) -> Tree:
    """Merge tree of a spanning tree's edges; ids: all its nodes, rising, which hold so many points each."""
    ends = np.concatenate([u, v])
    ids, ends = np.unique(ends, return_inverse=True) if ids is None else (ids, np.searchsorted(ids, ends))
    n, m = len(ids), len(u)
    order = np.lexsort((v, u, w))
    a, b = ends[:m][order].tolist(), ends[m:][order].tolist()
    sets, node = Sets(n), list(range(n))
    left, right, size = [], [], [1] * n if isinstance(held, int) else held.tolist()
    find, up = sets.find, sets.up
    for i, (x, y) in enumerate(zip(a, b, strict=True), n):
        x, y = find(x), find(y)
        if y < x:
            x, y = y, x
        p, q = node[x], node[y]
        left.append(p)
        right.append(q)
        size.append(size[p] + size[q])
        up[y] = x
        node[x] = i
    return Tree(ids, *(np.array(c, dtype=np.int64) for c in (left, right)), np.asarray(w, dtype=float)[order], np.array(size, dtype=np.int64))


def _inverse(d: float) -> float:
    return 1.0 / d if d > 0 else np.inf


def condense(t: Tree, min_size: int, profile: str, summed: bool = False) -> list[tuple[int, int, float, int]]:
    """(parent, child, lambda, size): children below n are points, those from n on are clusters; the root is n.

    summed: points that fall from a cluster together are one row, with child 0 and their number."""
    n, m = len(t.ids), len(t.left)
    if not n:
        return []
    met = np.zeros(n + m)
    met[t.left] = met[t.right] = t.dist
    # Lists, whose numbers take less time one by one than those of arrays.
    left, right, dist, weight = (a.tolist() for a in (t.left, t.right, t.dist, t.size))
    rows: list[tuple[int, int, float, int]] = []
    todo, fresh = [(n + m - 1, n)], n + 1

    def leaves(x: int):
        stack = [x]
        while stack:
            y = stack.pop()
            if y < n:
                yield y
            else:
                stack += [right[y - n], left[y - n]]

    at = 0
    while at < len(todo):
        node, cluster = todo[at]
        at += 1
        if node < n:  # the points of a place leave at distance 0
            rows.append((cluster, node, np.inf, weight[node]))
            continue
        if profile == "native":
            lam = 0.0 if node == n + m - 1 else float(np.float32(_inverse(float(np.float32(met[node])))))
        else:
            lam = _inverse(dist[node - n])
        sides = [left[node - n], right[node - n]]
        big = [s for s in sides if weight[s] >= min_size]
        for s in sides:
            if s not in big:
                rows += [(cluster, 0, lam, weight[s])] if summed else [(cluster, x, lam, weight[x]) for x in leaves(s)]
        for s in big:
            if len(big) == 2:
                rows.append((cluster, fresh, lam, weight[s]))
                todo.append((s, fresh))
                fresh += 1
            else:
                todo.append((s, cluster))
    return rows


class Clusters:
    """Clusters of one condensed tree, whose root is the smallest cluster number; children below it are points."""

    def __init__(self, rows: list[tuple[int, int, float, int]], root: int, profile: str):
        self.rows, self.root, self.profile = rows, root, profile
        self.children: dict[int, list[int]] = {root: []}
        self.birth, self.up = {root: 0.0}, {}
        self.size = {root: sum(size for _, child, _, size in rows if child < root)}
        for parent, child, lam, size in rows:
            if child >= root:
                self.children.setdefault(parent, []).append(child)
                self.children.setdefault(child, [])
                self.birth[child], self.size[child], self.up[child] = lam, size, parent
        self.stability = dict.fromkeys(self.children, 0.0)
        for parent, _, lam, size in rows:
            born = 0.0 if profile == "native" else self.birth[parent]
            self.stability[parent] += (0.0 if lam == born else lam - born) * size

    def below(self, c: int) -> list[int]:
        out, stack = [], list(self.children[c])
        while stack:
            x = stack.pop()
            out.append(x)
            stack += self.children[x]
        return out

    def _distance(self, c: int) -> float:
        return 0.0 if np.isinf(self.birth[c]) else _inverse(self.birth[c])

    def _climb(self, c: int, s: Selection) -> int:
        """The nearest ancestor born at epsilon or more; the root, or without allow_single_cluster the node below it."""
        while True:
            above = self.up[c]
            if above == self.root:
                return above if s.allow_single_cluster or self.profile == "native" else c
            far = self._distance(above)
            if far > s.epsilon or self.profile == "native" and far >= s.epsilon:
                return above
            c = above

    def merged(self, chosen: list[int], s: Selection) -> set[int]:
        """Clusters born below epsilon give way to an ancestor."""
        out: set[int] = set()
        done: set[int] = set()
        for c in sorted(chosen):
            if c in done:
                continue
            if c != self.root and self._distance(c) < s.epsilon:
                c = self._climb(c, s)
            out.add(c)
            done |= {c, *self.below(c)}
        return {c for c in out if not any(a in out for a in self.above(c))}

    def above(self, c: int) -> list[int]:
        out = []
        while c in self.up:
            c = self.up[c]
            out.append(c)
        return out

    def select(self, s: Selection) -> set[int]:
        can_root = s.allow_single_cluster or self.profile == "native"
        if s.method == "leaf":
            leaves = [c for c, x in self.children.items() if not x and c != self.root]
            if not leaves:
                return {self.root} if can_root else set()
            return self.merged(leaves, s) if s.epsilon > 0 else set(leaves)
        chosen, most = {c for c in self.children if c != self.root or can_root}, s.max_cluster_size or np.inf
        worth = dict(self.stability)
        for c in sorted(chosen, reverse=True):
            inner = sum(worth[x] for x in self.children[c])
            if self.children[c] and inner > worth[c] or self.size[c] > most:
                chosen.discard(c)
                worth[c] = inner
        # What is under a chosen cluster isn't chosen; parents have smaller numbers.
        under: set[int] = set()
        for c in sorted(self.up):
            if self.up[c] in under or self.up[c] in chosen:
                under.add(c)
        chosen -= under
        if s.epsilon > 0 and self.profile == "standard" and len(chosen - {self.root}) and len(self.children) > 1:
            chosen = self.merged(sorted(chosen), s)
        return chosen

    def labelled(self, chosen: set[int], s: Selection) -> list[tuple[int, int | None, float]]:
        """(point, cluster or None, strength) of every point."""
        home: dict[int, int | None] = {}
        for c in sorted(self.children):
            home[c] = c if c in chosen else home.get(self.up.get(c, -1))
        most: dict[int, float] = {}
        points = [(child, parent, lam) for parent, child, lam, _ in self.rows if child < self.root]
        for parent, _, lam, _ in self.rows:
            most[parent] = max(most.get(parent, 0.0), lam)
        only_root = chosen == {self.root} and self.profile == "standard"
        need = (_inverse(s.epsilon) if s.epsilon > 0 else max((lam for p, c, lam, _ in self.rows if p == self.root), default=0.0)) if only_root else 0.0
        out = []
        for x, parent, lam in points:
            c = home[parent]
            if c is None or only_root and lam < need:
                out.append((x, None, 0.0))
            else:
                top = most.get(c, 0.0)
                out.append((x, c, 1.0 if top == 0 or np.isinf(lam) else min(lam, top) / top))
        return out


def _outer(t: Tree, first: int, x: int) -> int:
    """Id of a point, or of an internal node or cluster."""
    n = len(t.ids)
    return int(t.ids[x]) if x < n else first + x - n


#: Merges and condensed rows in one table: kind 0 has node, left, right, dist, size, parent; kind 1 parent, child, lambda, size.
_TREE = "kind int, component bigint, a bigint, b bigint, c bigint, x double, size bigint, up bigint"
#: Clusters and points in one table: kind 0 has cluster, stability, size, children, selected; kind 1 point, cluster, probability.
_CHOSEN = "kind int, component bigint, a bigint, b bigint, x double, size bigint, children array<bigint>, selected boolean"


def _named(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def merge_trees(forest: DataFrame, first: int, selection: Selection = Selection()) -> tuple[DataFrame, DataFrame]:
    """The merge tree of each component (component, u, v, w), a row for each merge, and its condensed tree.

    Both come from one pass over the edges, which is written.
    """
    columns = _named(_TREE)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        component = int(pdf["component"].iloc[0])
        t = linkage(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy())
        n, m = len(t.ids), len(t.left)
        up = np.full(n + m, -1, dtype=np.int64)
        up[t.left] = up[t.right] = np.arange(n, n + m)
        outer = np.concatenate([t.ids, first + np.arange(m)])
        above = pd.array(first + up[n:] - n, dtype="Int64")
        above[up[n:] < 0] = pd.NA
        merges = pd.DataFrame({"kind": 0, "component": component, "a": outer[n:], "b": outer[t.left], "c": outer[t.right], "x": t.dist, "size": t.size[n:], "up": above})
        rows = condense(t, selection.min_cluster_size, selection.profile)
        parent, child, lam, size = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 4
        # Clusters are numbered like nodes, from the root on.
        condensed = pd.DataFrame({"kind": 1, "component": component, "a": first + parent - n, "b": np.where(child < n, outer[np.minimum(child, n - 1)], first + child - n), "c": 0, "x": lam, "size": size})
        condensed["up"] = pd.array([pd.NA] * len(condensed), dtype="Int64")
        return pd.concat([merges, condensed], ignore_index=True)[columns]

    made = written(forest.groupBy("component").applyInPandas(make, _TREE), "merge-trees")
    hierarchy = made.where("kind = 0").select("component", F.col("a").alias("node"), F.col("b").alias("left"), F.col("c").alias("right"), F.col("x").alias("dist"), "size", F.col("up").alias("parent"))
    condensed = made.where("kind = 1").select("component", F.col("a").alias("parent"), F.col("b").alias("child"), F.col("x").alias("lambda"), "size")
    return hierarchy.select(*_named(HIERARCHY)), condensed.select(*_named(CONDENSED))


def choose(condensed: DataFrame, first: int, selection: Selection = Selection()) -> tuple[DataFrame, DataFrame]:
    """From condensed trees: the clusters with stability, size, children and whether they are selected; and component, row_id,
    cluster (null: noise), probability of every point in them. Both come from one pass, which is written."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        component = int(pdf["component"].iloc[0])
        pdf = pdf.sort_values(["parent", "child"], kind="stable")
        rows = list(zip(pdf["parent"].tolist(), pdf["child"].tolist(), pdf["lambda"].tolist(), pdf["size"].tolist(), strict=True))
        tree = Clusters(rows, first, selection.profile)
        chosen = tree.select(selection)
        kept = [(0, component, c, None, tree.stability[c], tree.size[c], tree.children[c], c in chosen) for c in sorted(tree.children)]
        kept = pd.DataFrame(kept, columns=_named(_CHOSEN)).astype({"b": "Int64", "size": "Int64", "selected": "boolean"})
        points = pd.DataFrame(tree.labelled(chosen, selection), columns=["a", "b", "x"]).assign(kind=1, component=component, size=None, children=None, selected=None)
        return pd.concat([kept, points[kept.columns].astype({"b": "Int64", "size": "Int64", "selected": "boolean"})], ignore_index=True)

    made = written(condensed.groupBy("component").applyInPandas(make, _CHOSEN), "chosen")
    clusters = made.where("kind = 0").select("component", F.col("a").alias("cluster"), F.col("x").alias("stability"), "size", "children", "selected")
    points = made.where("kind = 1").select("component", F.col("a").alias("row_id"), F.col("b").alias("cluster"), F.col("x").alias("probability"))
    return clusters.select(*_named(CLUSTER)), points


def place_clusters(forest: DataFrame, places: DataFrame, first: int, selection: Selection = Selection()) -> DataFrame:
    """The clusters that `merge_trees` and `choose` give for all points, from one point for each place.

    places: row_id, n: the smallest id of a place, and its points, which are joined by edges of weight 0. forest: u, v, w of the one
    tree over places. No rows where a place of several points has another edge of weight 0, whose order isn't known then, or where
    the tree doesn't join all places. One task holds the places; it hands on the clusters only.
    """

    def make(edges: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row_id")
        ids, held = own["row_id"].to_numpy(), own["n"].to_numpy()
        u, v, w = (edges[c].to_numpy() for c in ("u", "v", "w"))
        zero = w == 0
        rows = []
        if len(u) == len(ids) - 1 and not (held[np.searchsorted(ids, np.concatenate([u[zero], v[zero]]))] > 1).any():
            n = len(ids)
            tree = Clusters(condense(linkage(u, v, w, ids, held), selection.min_cluster_size, selection.profile, summed=True), n, selection.profile)
            chosen, outer = tree.select(selection), first - n
            rows = [(int(ids[0]), c + outer, tree.stability[c], tree.size[c], [x + outer for x in tree.children[c]], c in chosen) for c in sorted(tree.children)]
        return pd.DataFrame(rows, columns=_named(CLUSTER))

    one = F.lit(0).alias("tree")
    return forest.groupBy(one).cogroup(places.groupBy(one)).applyInPandas(make, CLUSTER)


def labels(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """row_id, label (0 on, in order of component and cluster; noise -1), probability of every point."""
    numbered = ranked(chosen.where("cluster is not null").select("component", "cluster").distinct(), ["component", "cluster"], "label").withColumn("label", F.col("label").cast("int"))
    placed = chosen.join(numbered, ["component", "cluster"], "left").select("row_id", "label", "probability")
    return points.select("row_id").join(placed, "row_id", "left").select("row_id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def auto_epsilon(tree: DataFrame) -> float | None:
    """Epsilon at the elbow of the number of clusters by lambda, from the cluster rows of condensed trees.

    Lambdas in rising order, the number of clusters at each (children born up to it), first and second differences: the
    first lambda whose second difference is under 0.1 in size after one over 0.1; if there is none, the smallest; of fewer than
    three, the middle one. None where there is no lambda, or where it is 0.
    """
    born = tree.where("size > 1").select("lambda", "child")
    counts = born.groupBy("lambda").agg(F.count("*").alias("n"))
    w = Window.orderBy("lambda")  # one row for each distinct lambda of a cluster: min_cluster_size times fewer than points
    rows = counts.withColumn("n", F.sum("n").over(w)).withColumn("d1", F.col("n") - F.lag("n").over(w))
    rows = rows.withColumn("d2", F.col("d1") - F.lag("d1").over(w)).withColumn("i", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy()))
    rows = rows.withColumn("steep", F.max(F.when(F.abs("d2") > 0.1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    pick = rows.agg(
        F.min(F.when((F.abs("d2") < 0.1) & (F.col("steep") == 1), F.struct("i", "lambda"))).alias("elbow"),
        F.min("lambda").alias("low"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("i") == F.floor(F.col("total") / 2) + 1, F.col("lambda"))).alias("middle"),
    ).first()
    if not pick.total:
        return None
    lam = pick.middle if pick.total < 3 else pick.elbow["lambda"] if pick.elbow else pick.low
    return 1.0 / lam if lam > 0 else None


def stability_table(tree: DataFrame, profile: str = "standard") -> DataFrame:
    """component, cluster, stability from condensed rows, as aggregates and a self join."""
    born = tree.select("component", F.col("child").alias("parent"), F.col("lambda").alias("birth"))
    rows = tree.join(born, ["component", "parent"], "left") if profile == "standard" else tree.withColumn("birth", F.lit(0.0))
    gain = F.when(F.col("lambda") == F.coalesce("birth", F.lit(0.0)), 0.0).otherwise(F.col("lambda") - F.coalesce("birth", F.lit(0.0)))
    return rows.groupBy("component", F.col("parent").alias("cluster")).agg(F.sum(gain * F.col("size")).alias("stability"))


def cluster_leaves(tree: DataFrame) -> DataFrame:
    """component, cluster of the clusters that no cluster is split from."""
    cluster_rows = tree.where("size > 1")
    return cluster_rows.select("component", F.col("child").alias("cluster")).join(cluster_rows.select("component", F.col("parent").alias("cluster")), ["component", "cluster"], "left_anti")


def max_lambda(tree: DataFrame) -> DataFrame:
    """component, cluster, lambda: the largest lambda of each cluster's rows."""
    return tree.groupBy("component", F.col("parent").alias("cluster")).agg(F.max("lambda").alias("lambda"))


def descendants(tree: DataFrame) -> DataFrame:
    """component, cluster, below, depth: all clusters under each cluster, from the cluster rows of condensed trees.

    A component's clusters come to SHARES tasks at most, each of which climbs from a share of them, level by level, and hands on
    the pairs of a level at a time: a task holds the component's clusters, however many pairs there are.
    """
    rows = tree.where("size > 1").select("component", "parent", "child")
    shares = rows.groupBy("component").agg(F.least(F.ceil(F.count("*") / SHARE), F.lit(SHARES)).cast("int").alias("shares"))
    rows = rows.join(shares, "component").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    whole = spread(rows, "component", "share").groupBy("component", "share", "shares").agg(F.collect_list("parent").alias("parent"), F.collect_list("child").alias("child"))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                component, share, shares_ = (batch.column(c)[i].as_py() for c in ("component", "share", "shares"))
                parent, child = (batch.column(c)[i].values.to_numpy() for c in ("parent", "child"))
                by = np.argsort(child)
                parent, child = parent[by], child[by]
                at = np.searchsorted(child, parent)  # the parent's own row, if it has one
                up = np.where((at < len(child)) & (child[np.minimum(at, len(child) - 1)] == parent), at, -1)
                below = now = np.arange(share, len(child), shares_)
                depth, held, n = 1, [], 0
                while len(now):
                    held.append((parent[now], child[below], np.full(len(now), depth)))
                    n += len(now)
                    on = up[now] >= 0
                    below, now, depth = below[on], up[now[on]], depth + 1
                    if n >= PAIRS or not len(now):
                        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(n, component), *columns)], ["component", "cluster", "below", "depth"])
                        held, n = [], 0

    return whole.mapInArrow(climb, "component bigint, cluster bigint, below bigint, depth bigint")
