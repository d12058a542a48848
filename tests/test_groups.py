"""Hand-made goldens and invariants of the hierarchical grouping."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import dbscan as D
from lumenfold.operators import hierarchy as H
from lumenfold.operators import knn as K
from lumenfold.operators import mst
from lumenfold.operators.components import connected_components
from lumenfold.plans.estimator import DensityGrouping
from lumenfold.sources import tables as S
from lumenfold.storage import written

LINE = [0.0, 1.0, 2.0, 3.5, 10.0, 11.2, 12.0, 13.0, 40.0]


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame(list(enumerate(LINE)), "row_id long, x double")


@pytest.mark.parametrize(
    "profile, labels, stability",
    [("standard", [0, 0, 0, 0, 1, 1, 1, 1, -1], [1.2678, 3.0513, 3.2179]), ("native", [0, 0, 0, 0, 1, 1, 1, 1, 1], [1.2, 1.5357])],
)
def test_golden(line, profile, labels, stability):
    fit = DensityGrouping(3, 2, profile=profile, normalise=False, native_floor=2).fit(line, columns=["x"])
    assert [r.label for r in fit.labels.orderBy("row_id").collect()] == labels
    found = fit.clusters.orderBy("component", "cluster").collect()
    assert [round(r.stability, 4) for r in found] == stability
    table = H.stability_table(written(fit.condensed, "t"), profile).orderBy("component", "cluster").collect()
    assert [round(r.stability, 4) for r in table] == stability
    assert all(0 <= r.probability <= 1 for r in fit.labels.collect())


def test_odd_rows_and_duplicates(spark):
    rows = [(i, float(i % 3)) for i in range(12)] + [(20, None), (21, float("nan")), (22, float("inf"))]
    fit = DensityGrouping(3, 2, store_centers="both", allow_single_cluster=True).fit(spark.createDataFrame(rows, "row_id long, x double"), columns=["x"])
    got = {r.row_id: (r.label, r.probability) for r in fit.labels.collect()}
    assert got[20] == got[21] == (-3, None) and got[22] == (-2, 0.0)
    assert len({got[i][0] for i in range(0, 12, 3)}) == 1 and got[0][0] != got[1][0]
    assert all(r.stability >= 0 for r in fit.clusters.collect())
    assert fit.medoids.count() == fit.centroids.count() == len({x for x, _ in got.values() if x >= 0})


@pytest.mark.parametrize("bad", [{"min_cluster_size": 1}, {"metric": "none"}, {"alpha": 0}, {"cluster_selection_method": "x"}, {"min_samples": 0}, {"store_centers": "x"}, {"cluster_selection_epsilon": -1.0}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        DensityGrouping(**bad)


def test_too_few_rows(line):
    with pytest.raises(ValueError):
        DensityGrouping(3, 100).fit(line, columns=["x"])


def brute(points, k, metric="euclidean", w=None):
    out = {}
    for i, a in points:
        d = []
        for j, b in points:
            if i != j:
                terms = [(w[n] if w else 1.0) * ((x - y) ** 2 if metric == "euclidean" else abs(x - y)) for n, (x, y) in enumerate(zip(a, b))]
                d.append((math.sqrt(sum(terms)) if metric == "euclidean" else max(terms) if metric == "chebyshev" else sum(terms), j))
        out[i] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_knn_over_parts(spark, metric):
    rng = np.random.default_rng(3)
    points = [(int(i), [float(v) for v in p]) for i, p in enumerate(np.vstack([rng.normal(size=(150, 2)), np.zeros((60, 2)), rng.normal(8, 1, (90, 2))]).round(2))]
    df = spark.createDataFrame(points, "row_id long, features array<double>")
    got = K.knn(df, 4, metric, part=32).collect()
    want = brute(points, 4, metric)
    assert len(got) == 4 * len(points)
    for r in got:
        d, v = want[r.u][r["rank"] - 1]
        assert v == r.v and abs(d - r.dist) < 1e-9
    with pytest.raises(ValueError):
        K.knn(df.limit(3), 4)


@pytest.mark.parametrize("make", [lambda s: S.random_graph(s, 40, 90), lambda s: S.grid_graph(s, 6, 5), lambda s: S.sparse_graph(s, 30, 0.1), lambda s: S.complete_graph(s, 15)])
def test_forests_agree(spark, make):
    edges = written(make(spark), "g")
    want = {(r.u, r.v) for r in mst.kruskal(edges.toPandas()).itertuples()}
    for f in (mst.spanning_forest(edges), mst.spanning_forest(edges, most=20), mst.boruvka(edges)):
        f = written(f, "f")
        assert {(r.u, r.v) for r in f.collect()} == want
        assert mst.verify_forest(edges, f)


def test_complete_tree_in_blocks(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(int(i), [float(x), float(y)]) for i, (x, y) in enumerate(rng.normal(size=(70, 2)))], "row_id long, features array<double>")
    core = K.core_distances(K.knn(points, 3), 4, include_self=True)
    one, many = (mst.complete_tree(points, core, block=b).collect() for b in (1000, 20))
    assert {(r.u, r.v) for r in one} == {(r.u, r.v) for r in many} and len(one) == 69


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_tree_of_parts_is_the_tree(spark, metric):
    """Clouds far apart, equal points and an outlier: pruned parts give the edges that all points together give."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(5, 0.4, (90, 2)), rng.normal((20, 3), 0.1, (60, 2)), np.full((25, 2), 7.0), rng.random((60, 2)) * 30 + 1, [[300.0, 200.0]]]).round(2)
    points = written(spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>"), "t")
    dealt = K.deal(points, metric, part=24)
    near = written(K.knn(dealt, 4, metric), "n")
    core = K.core_distances(near, 4)
    want = {tuple(r) for r in mst.complete_tree(points, core, metric).collect()}
    assert len(want) == len(x) - 1 and len(dealt.known.names) > 8
    for given in (None, near) if metric == "euclidean" else (near,):
        assert {tuple(r) for r in mst.complete_tree(dealt, core, metric, near=given).collect()} == want


def test_large_cells_are_split(spark):
    rows = spark.range(600).select(F.col("id").alias("row_id"), F.array(F.when(F.col("id") < 400, 1.0).otherwise(F.col("id") / 7.0)).alias("features"))
    sizes = [r["count"] for r in K.parted(rows, 64).groupBy("part").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 64


@pytest.mark.parametrize("dim", [2, 4])
def test_cells_and_pairs_agree(spark, dim):
    rng = np.random.default_rng(dim)
    x = np.vstack([rng.normal(0, 0.3, (80, dim)), rng.normal(2, 0.05, (60, dim)), rng.random((60, dim)) * 6 - 1]).round(2)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    for eps, k in ((0.4, 5),):
        want = sorted(map(tuple, D._by_pairs(points, eps, k).collect()), key=str)
        assert sorted(map(tuple, D.dbscan(points, eps, k).collect()), key=str) == want


def test_dense_neighbours_that_few_points_do_not_join(spark):
    """Two dense cells, of which only one point each is near enough."""
    rows = [(i, [0.01 * (i % 7)]) for i in range(60)] + [(100, [0.45])] + [(200 + i, [1.49 + 0.001 * (i % 5)]) for i in range(60)] + [(300, [1.44])]
    got = {r.row_id: r.component for r in D.dbscan(spark.createDataFrame(rows, "row_id long, features array<double>"), 1.0, 5).collect()}
    assert set(got.values()) == {0}


def test_given_distances(spark):
    a = [(i, float(x)) for i, x in enumerate(LINE)]
    pairs = spark.createDataFrame([(i, j, abs(x - y)) for i, x in a for j, y in a if i < j], "u long, v long, dist double")
    for profile in ("standard", "native"):
        grouping = DensityGrouping(3, 2, profile=profile, normalise=False, native_floor=2)
        want = {r.row_id: (r.label, r.probability) for r in grouping.fit(spark.createDataFrame(a, "row_id long, x double"), columns=["x"]).labels.collect()}
        assert {r.row_id: (r.label, r.probability) for r in grouping.fit_distances(pairs).labels.collect()} == want


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (100, 100), (103, 102)] + [(200, 200 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 102, 103: 102} | {i: 200 for i in range(200, 240)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_selection_parameters(spark):
    rows = [(i, float(g * 20 + j * (0.5 + 0.1 * g))) for i, (g, j) in enumerate((g, j) for g in range(4) for j in range(8))]
    df = spark.createDataFrame(rows, "row_id long, x double")
    n = lambda **o: len({r.label for r in DensityGrouping(4, 2, **o).fit_predict(df, columns=["x"]).collect()} - {-1})
    assert n() == 4 and n(cluster_selection_method="leaf") >= 4
    assert n(cluster_selection_epsilon=30.0, allow_single_cluster=True) == 1
    assert n(max_cluster_size=8) == 4
    native = DensityGrouping(4, 2, profile="native", native_floor=2, cluster_selection_method="leaf").fit_predict(df, columns=["x"])
    assert native.count() == 32


def test_dbscan_and_parameters(spark):
    rows = [(i, [float(i // 10 * 50 + i % 10)]) for i in range(30)] + [(90, [500.0])]
    points = spark.createDataFrame(rows, "row_id long, features array<double>")
    labels = {r.row_id: r.label for r in D.numbered(D.dbscan(points, 1.5, 3)).collect()}
    assert labels == {i: i // 10 for i in range(30)} | {90: -1}
    assert D.estimated_eps(points, 3).first().eps > 0
    k, tried = D.choose_min_samples(points, lambda k: DensityGrouping(3, k).fit(points.select("row_id", F.col("features")[0].alias("x")), columns=["x"]).clusters)
    assert [t[0] for t in tried] == [2] and k == 2
