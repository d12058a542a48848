"""Fits of points of which many are equal, and trees of clusters that are deep."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import scaling
from lumenfold.operators import hierarchy as H
from lumenfold.operators import knn as K
from lumenfold.operators import mst
from lumenfold.plans.estimator import DensityGrouping


def _grid(spark, seed, places, n):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, places, (n, 2))
    # A few places are held by a few points only, and the smallest ids are dealt at random.
    ids = rng.permutation(n) * 3
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, at, strict=True)], "row_id long, x double, y double")


@pytest.mark.parametrize(("seed", "places", "k"), [(1, 8, 5), (2, 12, 4), (3, 1, 5), (4, 2, 90), (5, 9, 1)])
def test_equal_points_stand_for_each_other(spark, monkeypatch, seed, places, k):
    rows = _grid(spark, seed, places, 400)
    points = scaling.features(rows, "row_id", ["x", "y"])
    whole = K.deal(points)
    core = K.core_distances(K.knn(whole, max(1, k - 1)), k, include_self=True)
    want = {tuple(r) for r in mst.complete_tree(whole, core).collect()}
    cores = {r.row_id: r.core for r in core.collect()}
    dealt, deal = [], K.deal
    monkeypatch.setattr(K, "deal", lambda *a, **b: dealt.append(deal(*a, **b)) or dealt[-1])
    got = DensityGrouping(20, k).fit(rows, columns=["x", "y"])
    assert {(r.u, r.v, r.w) for r in got.forest.collect()} == want
    assert {r.row_id: r.core for r in got.core.collect()} == cores
    assert {r.component for r in got.forest.select("component").distinct().collect()} == {0}
    held = rows.groupBy("x", "y").count().agg(F.sum(F.when(F.col("count") >= k, 1).otherwise(F.col("count")))).first()[0]
    assert [d.n for d in dealt] == [held]


def test_distances_rounded_to_0(spark):
    """Two places 1e-200 apart are different, but their distance is 0: their tree is that of all points."""
    rows = spark.createDataFrame([(i, 1e-200 * (i % 2) + i // 20) for i in range(60)], "row_id long, x double")
    points = scaling.features(rows, "row_id", ["x"])
    core = K.core_distances(K.knn(points, 2), 3, include_self=True)
    want = {tuple(r) for r in mst.complete_tree(points, core).collect()}
    assert {(r.u, r.v, r.w) for r in DensityGrouping(5, 3).fit(rows, columns=["x"]).forest.collect()} == want


def test_one_tree_needs_no_components(spark, monkeypatch):
    forest = spark.createDataFrame([(7, 9, 1.0), (3, 9, 2.0)], "u long, v long, w double")
    with monkeypatch.context() as m:
        m.setattr(mst, "components", None)
        assert {tuple(r) for r in mst.forest_components(forest, 3).collect()} == {(3, 7, 9, 1.0), (3, 3, 9, 2.0)}
    assert {tuple(r) for r in mst.forest_components(spark.createDataFrame([(1, 2, 1.0), (5, 4, 1.0)], "u long, v long, w double"), 4).collect()} == {(1, 1, 2, 1.0), (4, 5, 4, 1.0)}


def _clusters(table):
    rows = sorted(table.collect(), key=lambda r: (r.component, r.cluster))
    return [(r.component, r.cluster, r.size, r.children, r.selected) for r in rows], [r.stability for r in rows]


@pytest.mark.parametrize(("seed", "places", "n", "tried"), [(1, 8, 400, (3, 4)), (2, 12, 400, (4, 3, 90)), (3, 1, 60, (1, 5)), (4, 2, 300, (2, 80)), (5, 14, 400, (1, 2, 6)), (6, 10**6, 200, (3, 4)), (7, 40, 600, (2, 3))])
def test_clusters_for_several_min_samples(spark, seed, places, n, tried):
    rows = _grid(spark, seed, places, n)
    got = DensityGrouping(6).clusters_for(rows, tried, columns=["x", "y"])
    assert list(got) == sorted(tried)
    for k in tried:
        (same, stability), (want, wanted) = _clusters(got[k]), _clusters(DensityGrouping(6, k).fit(rows, columns=["x", "y"]).clusters)
        assert same == want
        assert stability == pytest.approx(wanted, rel=1e-9)


def test_clusters_for_distances_rounded_to_0(spark):
    """Places 1e-200 apart, of which one holds few points; and rows that can't be placed, or are too few."""
    rows = spark.createDataFrame([(i, 1e-200 * (i % 7 == 0) + i // 20) for i in range(60)] + [(70, None), (71, float("nan")), (72, float("inf"))], "row_id long, x double")
    got = DensityGrouping(5).clusters_for(rows, (2, 3), columns=["x"])
    for k in (2, 3):
        assert _clusters(got[k]) == _clusters(DensityGrouping(5, k).fit(rows, columns=["x"]).clusters)
    with pytest.raises(ValueError):
        DensityGrouping(5).clusters_for(rows, (2, 61), columns=["x"])


def test_min_samples_choice_looks_once_at_each_place(spark, sf, tmp_path, monkeypatch):
    """Parts repeated 5 times: both fits share one search, among one point for each place, and make no labels."""
    from lumenfold.plans import catalog

    part = spark.read.parquet(f"{sf}/part.parquet")
    part.crossJoin(spark.range(5)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 1000).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    k = part.select("p_size", "p_retailprice").distinct().count()
    dealt, deal = [], K.deal
    monkeypatch.setattr(K, "deal", lambda *a, **b: dealt.append(deal(*a, **b)) or dealt[-1])
    monkeypatch.setattr(H, "labels", None)
    assert [r.k for r in catalog.min_samples_choice(spark, str(tmp_path)).collect()] == [3, 4]
    assert [d.n for d in dealt] == [k]


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 40, 30), (2, 40, 200), (3, 500, 3000), (4, 5, 40), (5, 2, 1)])
def test_first_edges(seed, n, m):
    a, b = np.random.default_rng(seed).integers(0, n, (2, m))
    sets = mst.Sets(n)
    assert mst.first_edges(a, b, n).tolist() == [sets.join(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_descendants_of_deep_trees(spark):
    """A chain of 2500 clusters in one component, a small tree in another."""
    n, first = 2500, 10**6
    rows = [(1, first + i, first + i + 1, 1.0, 5) for i in range(n)] + [(2, 50, 51, 1.0, 9), (2, 50, 52, 1.0, 9), (2, 52, 53, 1.0, 4), (2, 52, 54, 2.0, 4), (2, 54, 3, 2.0, 1)]
    got = H.descendants(spark.createDataFrame(rows, "component long, parent long, child long, lambda double, size long"))
    assert {tuple(r) for r in got.where("component = 2").collect()} == {(2, 50, 51, 1), (2, 50, 52, 1), (2, 50, 53, 2), (2, 50, 54, 2), (2, 52, 53, 1), (2, 52, 54, 1)}
    chain = got.where("component = 1")
    assert chain.agg(F.count("*"), F.countDistinct("cluster", "below"), F.sum((F.col("below") - F.col("cluster") != F.col("depth")).cast("int"))).first()[:] == (n * (n + 1) // 2, n * (n + 1) // 2, 0)


def test_selection_of_deep_trees():
    """Each cluster of a chain is worth more than all under it: the outermost one is chosen, in time linear in the clusters."""
    n, root = 15_000, 10
    rows = [(root + i, root + i + 1, 1.0 - 0.5 / (i + 1), n - i) for i in range(n)] + [(root + n, x, 1.5, 1) for x in range(root)]
    tree = H.Clusters(rows, root, "standard")
    tree.stability = {c: float(n - c) for c in tree.stability}
    began = time.perf_counter()
    assert tree.select(H.Selection(2)) == {root + 1}
    assert time.perf_counter() - began < 3


@pytest.mark.parametrize(("k", "alpha", "spread_ids"), [(3, 1.0, 1), (5, 0.5, 10**12), (1, 1.0, 1)])
def test_given_distances(spark, monkeypatch, k, alpha, spread_ids):
    """Pairs given twice, both ways and with ties, in tasks that each see some of them and drop what they can do without, against
    every pair in tables."""
    from lumenfold.operators import given as G

    monkeypatch.setattr(G, "HELD", 50)
    rng = np.random.default_rng(k)
    at = rng.integers(0, 30, 60)
    pairs = [(i * spread_ids, j * spread_ids, float(abs(at[i] - at[j]))) for i in range(60) for j in range(60) if i != j and rng.random() < 0.7]
    pairs += [(u, v, w + 1) for u, v, w in pairs[:100]] + [(0, 0, 1.0), (0, 7, None)]
    given = spark.createDataFrame(pairs, "u long, v long, dist double").repartition(3)
    fit = lambda: DensityGrouping(3, k, alpha=alpha).fit_distances(given)
    made = []
    with monkeypatch.context() as m:
        m.setattr(K, "undirected", lambda *a: made.append(a))
        few = fit()
    assert not made
    monkeypatch.setattr(G, "NODES", 10)
    whole = fit()
    for name in ("forest", "core", "labels"):
        assert sorted(map(tuple, getattr(few, name).collect())) == sorted(map(tuple, getattr(whole, name).collect()))


def test_core_by_pairs(spark):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(rng.integers(0, 50, 120))], "row_id long, features array<double>")
    got = {r.row_id: r.core for r in K.core_by_pairs(points, 3, block=25).collect()}
    x = np.array([r.features[0] for r in points.orderBy("row_id").collect()])
    d = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(d, np.inf)
    assert got == dict(enumerate(np.sort(d, axis=1)[:, 2]))
    assert {r.core for r in K.core_by_pairs(points.limit(3), 3).collect()} == {None}


def test_every_pair_is_spread(spark, sf):
    """One small file is one task's work unless one side of the pairs is dealt."""
    from lumenfold.plans import catalog

    assert catalog.complete_graph_edges(spark, sf).rdd.getNumPartitions() > 1
