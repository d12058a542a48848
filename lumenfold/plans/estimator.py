"""Hierarchical density grouping in one call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from numbers import Integral, Real

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scaling
from ..functions.constraints import check, number, one_of
from ..functions.distance import Metric, metric_name
from ..operators import given as G
from ..operators import hierarchy as H
from ..operators import knn as K
from ..operators import metrics as M
from ..operators import mst
from ..storage import written

#: Labels of rows that can't be placed.
INFINITE, MISSING = -2, -3
#: Smallest cluster of the native profile, whatever is asked for.
NATIVE_FLOOR = 20

CONSTRAINTS = {
    "min_cluster_size": [number(Integral, 2, None)],
    "min_samples": [number(Integral, 1, None), None],
    "cluster_selection_epsilon": [number(Real, 0, None)],
    "max_cluster_size": [number(Integral, 1, None), None],
    "metric": [str, Integral, "callable"],
    "p": [number(Real, 0, None, "neither")],
    "weights": ["mapping", "array-like", None],
    "alpha": [number(Real, 0, None, "neither")],
    "cluster_selection_method": [one_of("eom", "leaf")],
    "allow_single_cluster": ["boolean"],
    "store_centers": [one_of("centroid", "medoid", "both"), None],
    "profile": [one_of("standard", "native")],
    "normalise": ["boolean", None],
    "native_floor": [number(Integral, 1, None)],
}


@dataclass
class Fitted:
    """Tables of a fit, all of them written."""

    labels: DataFrame
    clusters: DataFrame
    condensed: DataFrame
    hierarchy: DataFrame
    forest: DataFrame
    core: DataFrame
    centroids: DataFrame | None = None
    medoids: DataFrame | None = None


@dataclass
class DensityGrouping:
    """Parameters of a fit. `profile` chooses between the published definition ('standard': raw values, the complete
    mutual-reachability graph, k counts the point itself) and the 'native' one (scaled to [0, 1], the graph of the k nearest others,
    parents' lambdas, at least 20 rows to a cluster, and for leaves an epsilon taken from the elbow)."""

    min_cluster_size: int = 5
    min_samples: int | None = None
    cluster_selection_epsilon: float = 0.0
    max_cluster_size: int | None = None
    metric: Metric = "euclidean"
    p: float = 2.0
    weights: Mapping[str, float] | Sequence[float] | None = None
    alpha: float = 1.0
    cluster_selection_method: str = "eom"
    allow_single_cluster: bool = False
    store_centers: str | None = None
    profile: str = "standard"
    normalise: bool | None = None
    native_floor: int = NATIVE_FLOOR
    columns: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self):
        metric_name(self.metric)
        check(type(self).__name__, CONSTRAINTS, vars(self))
        self._selection()

    def _selection(self, epsilon: float | None = None) -> H.Selection:
        size = max(self.native_floor, self.min_cluster_size) if self.profile == "native" else self.min_cluster_size
        eps = self.cluster_selection_epsilon if epsilon is None else epsilon
        return H.Selection(size, self.cluster_selection_method, self.profile, eps, self.allow_single_cluster, self.max_cluster_size)

    def fit(self, df: DataFrame, id_col: str = "row_id", columns: Sequence[str] | None = None) -> Fitted:
        """Group the rows of df by its feature columns. Rows with a null or NaN are labelled -3, with an infinite value -2."""
        columns = list(columns or self.columns)
        rows = written(self._rows(df, id_col, columns), "fit-rows")
        points = self._points(rows, columns)
        n, top = points.agg(F.count("*"), F.coalesce(F.max("row_id"), F.lit(0))).first()
        k = self.min_samples or self.min_cluster_size
        if n < 2 or k > n:
            raise ValueError(f"{n} rows for min_samples {k}")
        weights = self._weights(columns)
        native = self.profile == "native"
        found = None if native else self._by_places(points, k, weights)
        if found:
            core, forest = found
            return self._grouped(points, rows, forest, core, n, top + 1)
        dealt = K.deal(points, self.metric, self.p, weights)
        near = written(K.knn(dealt, k if native else max(1, k - 1), self.metric, self.p, weights), "fit-knn")
        core = written(K.core_distances(near, k, include_self=not native), "fit-core")
        if native:
            edges = K.undirected(K.mutual_reachability(near, core))
            forest = mst.spanning_forest(edges.withColumn("w", F.col("w").cast("float").cast("double")))
        else:
            forest = mst.complete_tree(dealt, core, self.metric, self.alpha, self.p, weights, near)
        return self._grouped(points, rows, forest, core, n, top + 1)

    def _rows(self, df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
        """row_id, the columns as f0, f1, ..., and the label of rows that can't be placed as odd."""
        cells = [F.col(c).cast("double") for c in columns]
        names = [f"f{i}" for i in range(len(columns))]
        rows = df.select(F.col(id_col).cast("long").alias("row_id"), *(c.alias(n) for n, c in zip(names, cells, strict=True)))
        missing = F.lit(False)
        infinite = F.lit(False)
        for n in names:
            missing |= F.col(n).isNull() | F.isnan(n)
            infinite |= F.abs(n) == float("inf")
        return rows.withColumn("odd", F.when(missing, MISSING).when(infinite, INFINITE))

    def _points(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        names = [f"f{i}" for i in range(len(columns))]
        good = rows.where("odd is null").drop("odd")
        normalise = self.profile == "native" if self.normalise is None else self.normalise
        if normalise:
            good = scaling.min_max(good, names)
        return scaling.features(good, "row_id", names)

    def _weights(self, columns: Sequence[str]) -> Sequence[float] | None:
        return [self.weights.get(c, 1.0) for c in columns] if isinstance(self.weights, Mapping) else self.weights

    def _plain(self, weights: Sequence[float] | None) -> bool:
        """Whether points have distance 0 where they are equal, and otherwise only by rounding."""
        return metric_name(self.metric) in K.PLAIN and (weights is None or min(weights) > 0)

    def clusters_for(self, df: DataFrame, tried: Sequence[int], id_col: str = "row_id", columns: Sequence[str] | None = None) -> dict[int, DataFrame]:
        """`fit(...).clusters` for each of several min_samples, whose fits share places and neighbours; two trees grow at a time.

        One point stands for all at a place that holds as many points as the largest min_samples, as in `_by_places`; it counts
        as so many in the merge tree.
        """
        columns, tried = list(columns or self.columns), sorted(set(tried))
        alone = lambda k: replace(self, min_samples=k).fit(df, id_col, columns).clusters
        weights = self._weights(columns)
        if self.profile == "native" or not self._plain(weights):
            return {k: alone(k) for k in tried}
        most = tried[-1]
        points = self._points(self._rows(df, id_col, columns), columns)
        places = written(points.groupBy("features").agg(F.min("row_id").alias("row_id"), F.max("row_id").alias("top"), F.count("*").alias("n")), "fit-places")
        some = (F.col("n") > 1) & (F.col("n") < most)
        n, top, few = places.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("top"), F.lit(0)), F.coalesce(F.sum(some.cast("int")), F.lit(0))).first()
        if n < 2 or most > n:
            raise ValueError(f"{n} rows for min_samples {most}")
        held = places.where(~some).select("row_id", "features", "n")
        if few:
            apart = points.join(places.where(some).select("features"), "features", "left_semi")
            held = written(held.unionByName(apart.select("row_id", "features", F.lit(1).cast("long").alias("n"))), "fit-held")
        dealt = K.deal(held, self.metric, self.p, weights)
        if dealt.n == 1:
            return {k: alone(k) for k in tried}
        many = held.where("n > 1").select(F.col("row_id").alias("v"), F.lit(True).alias("many"))
        near = K.knn(dealt, min(max(1, most - 1), dealt.n - 1), self.metric, self.p, weights)
        near = written(near.join(many, "v", "left"), "fit-knn")

        def clusters(k: int) -> DataFrame:
            enough = F.when((F.col("rank") == k - 1) | F.col("many"), F.col("dist"))
            core = near.groupBy(F.col("u").alias("row_id")).agg(F.min(enough).alias("core")).join(held.select("row_id", "n"), "row_id")
            core = written(core.select("row_id", F.when(F.lit(k == 1) | (F.col("n") > 1), 0.0).otherwise(F.col("core")).alias("core")), "fit-core")
            tree = mst.complete_tree(dealt, core, self.metric, self.alpha, self.p, weights, near)
            found = written(H.place_clusters(tree, held.select("row_id", "n"), top + 1, self._selection()), "chosen")
            return alone(k) if found.isEmpty() else found

        with ThreadPoolExecutor(2) as pool:
            return dict(zip(tried, pool.map(inheritable_thread_target(df.sparkSession)(clusters), tried), strict=True))

    def _by_places(self, points: DataFrame, k: int, weights: Sequence[float] | None) -> tuple[DataFrame, DataFrame] | None:
        """Core distances and the tree, with one point for each place that holds k points or more; None where that doesn't apply.

        The core distance of such points is 0, so that they are joined by edges of weight 0, in order of (w, u, v) from the
        smallest of them to each other one. All have the same distances to the rest, and of equal edges that of the smallest comes
        first: it stands for all. Neighbours are looked for among those that are left, where one that stands for others is k.
        """
        if not self._plain(weights):
            return None
        places = points.groupBy("features").agg(F.count("*").alias("n"), F.min("row_id").alias("home")).where((F.col("n") > 1) & (F.col("n") >= k))
        marked = written(points.join(places, "features", "left").select("row_id", "features", "home"), "fit-places")
        copies = marked.where("home <> row_id")
        if copies.isEmpty():
            return None
        few = marked.where("home is null or home = row_id")
        star = copies.select(F.col("home").alias("u"), F.col("row_id").alias("v"), F.lit(0.0).alias("w"))
        zero = marked.where("home is not null").select("row_id", F.lit(0.0).alias("core"))
        dealt = K.deal(few, self.metric, self.p, weights)
        if dealt.n == 1:
            return written(zero, "fit-core"), star
        reach = max(1, k - 1)
        near = written(K.knn(dealt, min(reach, dealt.n - 1), self.metric, self.p, weights), "fit-knn")
        many = few.where("home is not null").select(F.col("row_id").alias("v"), F.lit(True).alias("many"))
        enough = F.when((F.col("rank") == reach) | F.col("many"), F.col("dist"))
        alone = few.where("home is null").select(F.col("row_id").alias("u"))
        single = near.join(alone, "u").join(many, "v", "left").groupBy(F.col("u").alias("row_id")).agg(F.min(enough).alias("core"))
        core = written(zero.unionByName(single.withColumn("core", F.lit(0.0) if k == 1 else F.col("core"))), "fit-core")
        tree = written(mst.complete_tree(dealt, core, self.metric, self.alpha, self.p, weights, near), "fit-tree")
        # Places so near each other that their distance is rounded to 0 have edges of weight 0 in an order of their own.
        return (core, tree.unionByName(star)) if tree.where("w = 0").isEmpty() else None

    def fit_distances(self, distances: DataFrame) -> Fitted:
        """Group rows by given distances: u, v, dist of pairs, each pair once or both ways. Pairs that are left out aren't joined directly.

        The pairs are read more than once."""
        native = self.profile == "native"
        k = self.min_samples or self.min_cluster_size
        nodes = None if native else G.nodes_of(distances)
        if nodes is not None and len(nodes):
            near = written(G.nearest_given(distances, nodes, max(1, k - 1)), "fit-knn")
            core = written(K.core_distances(near, k, include_self=True), "fit-core")
            return self._grouped(core.select("row_id"), None, G.forest_given(distances, nodes, core, self.alpha), core, len(nodes), int(nodes[-1]) + 1)
        pairs = written(K.undirected(distances.select(F.col("u").cast("long"), F.col("v").cast("long"), F.col("dist").cast("double").alias("w")).where("u <> v and w is not null")), "fit-pairs")
        both = pairs.select("u", "v", F.col("w").alias("dist")).unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("dist")))
        near = both.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("dist", "v"))).where(F.col("rank") <= (k if native else max(1, k - 1)))
        near = written(near, "fit-knn")
        core = written(K.core_distances(near, k, include_self=not native), "fit-core")
        edges = K.undirected(K.mutual_reachability(near if native else both, core, 1.0 if native else self.alpha))
        forest = mst.spanning_forest(edges.withColumn("w", F.col("w").cast("float").cast("double")) if native else edges)
        points = core.select("row_id")
        n, top = points.agg(F.count("*"), F.coalesce(F.max("row_id"), F.lit(0))).first()
        return self._grouped(points, None, forest, core, n, top + 1)

    def _grouped(self, points: DataFrame, rows: DataFrame | None, forest: DataFrame, core: DataFrame, n: int, first: int) -> Fitted:
        forest = written(mst.forest_components(written(forest, "fit-tree"), n), "fit-forest")
        hierarchy, condensed = H.merge_trees(forest, first, self._selection())
        epsilon = None
        if self.profile == "native" and self.cluster_selection_method == "leaf":
            epsilon = H.auto_epsilon(condensed) or 0.0
        clusters, chosen = H.choose(condensed, first, self._selection(epsilon))
        labels = H.labels(points, chosen)
        if rows is not None:
            odd = rows.where("odd is not null").select("row_id", F.col("odd").alias("label"), F.when(F.col("odd") == INFINITE, 0.0).alias("probability"))
            labels = labels.unionByName(odd)
        labels = written(labels, "fit-labels")
        fitted = Fitted(labels, clusters, condensed, hierarchy, forest, core)
        if rows is None:
            return fitted
        real = labels.where("label >= 0")
        if self.store_centers in ("centroid", "both"):
            fitted.centroids = M.weighted_centroids(points, real)
        if self.store_centers in ("medoid", "both"):
            fitted.medoids = M.weighted_medoids(points, real, self.metric)
        return fitted

    def fit_predict(self, df: DataFrame, id_col: str = "row_id", columns: Sequence[str] | None = None) -> DataFrame:
        return self.fit(df, id_col, columns).labels
