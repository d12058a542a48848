"""Sources, batching, streams, distances and benchmark helpers."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import distance as dist
from lumenfold.functions import scaling
from lumenfold.operators import batching as B
from lumenfold.operators import metrics as M
from lumenfold.plans import benchmark
from lumenfold.sources import tables as S
from lumenfold.streaming.time_batches import stream_batches

TRUE = [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
PRED = [0, 0, 1, -1, 2, 2, 2, 2, -1, -1]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(zip(TRUE, PRED)), "true int, pred int")


def test_scores(pairs):
    r = M.agreement(pairs).first()
    assert round(r.ari, 6) == 0.28 and round(r.nmi, 6) == round(r.v_measure, 6) == 0.568241
    assert round(r.homogeneity, 6) == 0.618066 == round(r.native_completeness, 6)
    assert round(r.completeness, 5) == 0.52585 == round(r.native_homogeneity, 5)
    assert M.matching_accuracy(pairs).first().accuracy == 0.5
    kinds = {r["true"]: (r.kind, r.n_noise, r.distribution) for r in M.emitter_perspective(pairs).collect()}
    assert kinds == {1: ("broken_up", 1, {0: 2, 1: 1}), 2: ("merged", 0, {2: 3}), 3: ("merged", 2, {2: 1})}
    clusters = {r.pred: (r.kind, r.coverage, r.broken_up) for r in M.cluster_perspective(pairs).collect()}
    assert clusters[0] == ("pure", 0.5, True) and clusters[1] == ("pure", 0.25, True) and clusters[2][0] == "impure"
    q = M.quality_summary(pairs).first()
    assert (q.correct, q.incorrect, round(q.correctness, 4)) == (1, 2, 0.3333)
    same = pairs.select("true", F.col("true").alias("pred"))
    assert round(M.agreement(same).first().ari, 9) == 1


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "true int, pred int")
    assert M.agreement(empty).first().n == 0 and M.agreement(empty).first().ari == 0
    assert M.quality_summary(empty).first().correctness == 0
    assert M.basic_quality(empty, "pred").first().n_clusters == 0


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TOA,PW,FREQ,Amp,EmitterId\n1,2,3,4,7\n\n# note\n5,x,6,7,8\n9,10,11,12,-1\n")
    got = S.read_pulses(spark, str(tmp_path / "a.csv"), skip=(0, 3)).orderBy("PW").collect()
    assert [tuple(r) for r in got] == [(2.0, 3.0, 7), (10.0, 11.0, -1)]
    plain = S.read_pulses(spark, str(tmp_path / "a.csv"), label=False, dimensions=2)
    assert plain.columns == ["TOA", "PW"] and plain.count() == 2
    assert {r.file for r in S.read_folder(spark, str(tmp_path)).collect()} == {"a.csv"}


def test_parameters_and_graphs(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Name Min_Samples Eps\na 3 0.5\n\nb  4 0.25\n")
    p = S.read_parameters(spark, str(tmp_path / "p.txt"))
    assert sorted(map(tuple, p.collect())) == [("a", 3, 0.5), ("b", 4, 0.25)]
    assert S.read_parameters(spark, str(tmp_path / "none.txt")).count() == 0
    got = S.with_parameters(spark.createDataFrame([("a",), ("z",)], "name string"), p)
    assert {r.name: (r.min_samples, r.eps) for r in got.collect()} == {"a": (3, 0.5), "z": (5, 0.38)}
    e = S.random_graph(spark, 10, 20)
    S.write_edges(e, str(tmp_path / "e"))
    assert S.read_edges(spark, str(tmp_path / "e")).exceptAll(e).isEmpty()
    S.write_graph(e, str(tmp_path / "g"))
    assert S.read_graph(spark, str(tmp_path / "g")).count() == e.count()
    S.write_parameters(p, str(tmp_path / "w"))
    assert S.read_parameters(spark, str(tmp_path / "w")).count() == 2


def test_generated(spark):
    b = S.blobs(spark, 300, anisotropic=True)
    assert b.count() == 300 and b.select("label").distinct().count() == 10
    assert S.grid_graph(spark, 4, 3).count() == 17 and S.complete_graph(spark, 8).count() == 28
    w = S.sparse_graph(spark, 20, 0.2).agg(F.min("w"), F.max("w")).first()
    assert 1 <= w[0] and w[1] < 5


@pytest.mark.parametrize("metric", dist.METRICS)
def test_distance_both_ways(spark, metric):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 3)), rng.normal(size=(20, 3))
    w = [[2.0, 0.3, 0.1], [0.3, 1.0, 0.2], [0.1, 0.2, 1.5]] if metric == "mahalanobis" else (0.5, 1.5, 2.0)
    if metric in (*dist.TRUTH, "hamming"):
        a, b = (a > 0).astype(float), (b > 0).astype(float)
    if metric == "haversine":
        a, b = a[:, :2], b[:, :2]
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "i int, a array<double>, b array<double>")
    got = [r.d for r in df.select("i", dist.distance(F.col("a"), F.col("b"), metric, 3.0, w).alias("d")).orderBy("i").collect()]
    assert np.allclose(got, np.diag(dist.block_distance(a, b, metric, 3.0, w)))
    zero = spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>").select(dist.distance(F.col("a"), F.col("b"), "dso").alias("d")).first()
    assert zero.d is None
    with pytest.raises(ValueError):
        dist.distance(F.col("a"), F.col("b"), "minkowski", p=0)


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, None), (3, 5.0, 4.0)], "id int, a double, b double")
    assert [(r.a, r.b) for r in scaling.min_max(df, ["a", "b"]).orderBy("id").collect()] == [(0.0, 0.0), (0.0, None), (0.0, 1.0)]
    assert [(r.a, r.b) for r in scaling.z_score(df, ["a", "b"]).orderBy("id").collect()] == [(0.0, -1.0), (0.0, None), (0.0, 1.0)]
    with pytest.raises(ValueError):
        scaling.jitter(df, {"c": 1.0})
    with pytest.raises(ValueError):
        scaling.std_range_weights(df, {"a": 0})


def test_batches(spark):
    rows = [(i, "a" if i % 2 else "b", float(i)) for i in range(12)] + [(20, "c", 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, t double")
    got = B.greedy_batches(df, "g", "t", 4.0).orderBy("g", "batch").collect()
    assert [(r.g, r.batch, r.start_time, r.end_time, r.n) for r in got] == [("a", 0, 1, 5, 3), ("a", 1, 7, 11, 3), ("b", 0, 0, 4, 3), ("b", 1, 6, 10, 3), ("c", 0, 1, 1, 1)]
    assert B.fixed_sample(df, 2, 6, "g", "t", "id").count() == 6
    with pytest.raises(ValueError):
        B.fixed_sample(df, 3, 6, "g", "t", "id")
    with pytest.raises(ValueError):
        B.first_groups(df, [4], "g", "id")
    assert {r.batch: r["count"] for r in B.first_groups(df, [1, 3], "g", "id").groupBy("batch").count().collect()} == {1: 6, 3: 13}
    assert B.batch_configs(B.greedy_batches(df, "g", "t", 4.0), "time", "x").count() == 5


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"g{i % 3}", float((i * 37) % 101) / 4) for i in range(90)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "g string, t double")
    want = {(r.g, r.batch, r.start_time, r.end_time, r.n) for r in B.greedy_batches(df, "g", "t", 2.5).collect()}
    for i, part in enumerate((df.where("t < 9"), df.where("t >= 9 and t < 17"), df.where("t >= 17"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05 * (i < 2))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_batches(stream, "g", "t", 2.5).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from closed").collect()}
    last = {max((r for r in want if r[0] == g), key=lambda r: r[1]) for g in ("g0", "g1", "g2")}
    assert got == want - last


def test_benchmark(spark):
    rows = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 4).cast("int").alias("true"))
    out = benchmark.run_batches([("x", rows)], {"same": lambda r: r.select("row_id", F.col("true").alias("label"))}, "true").first()
    assert (out.clusters, out.correct, out.ari, out.timeout) == (4, 4, 1.0, False)
    assert benchmark.predicted_seconds([1, 2, 3], [1, 4, 9], 4) == pytest.approx(16)
    assert benchmark.predicted_seconds([1], [1], 4) is None
    assert benchmark.predicted_seconds([1, 2], [5, 1], 9) == 0


def test_folder_parameters(spark, tmp_path):
    from lumenfold.plans.parameters import estimate_folder

    (tmp_path / "in").mkdir()
    for name, gap in (("one", 1), ("two", 3)):
        rows = [f"{g * 50 + i * gap},{g}" for g in range(3) for i in range(8)]
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join(["x,EmitterId", *rows]) + "\n")
    got = {r.name: (r.min_samples, r.eps) for r in estimate_folder(spark, str(tmp_path / "in"), ["x"], 3).collect()}
    assert set(got) == {"one", "two"} and all(k == 2 and e > 0 for k, e in got.values())
    with pytest.raises(ValueError):
        estimate_folder(spark, str(tmp_path / "in"), ["y"])


def test_command_line(spark, tmp_path, capsys):
    from lumenfold.__main__ import run

    rows = [f"{g * 50 + i},{i % 3},{g}" for g in range(2) for i in range(25)]
    (tmp_path / "a.csv").write_text("\n".join(["x,y,EmitterId", *rows]) + "\n")
    labels = run(spark, ["--input", str(tmp_path / "a.csv"), "--dimensions", "2", "--minpts", "3", "--metric", "2", "--labelled", "--no-norm"])
    assert labels.count() == 50 and labels.where("label >= 0").select("label").distinct().count() == 2
    assert "ari" in capsys.readouterr().out


def test_sizes(spark):
    rows = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("true"))
    same = {"a": lambda r: r.select("row_id", F.col("true").alias("label")), "b": lambda r: r.select("row_id", F.lit(-1).alias("label"))}
    got = benchmark.run_sizes(rows, [6, 12], same, "true", most={"b": 6})
    assert sorted((r.batch, r.algorithm, r.samples) for r in got.collect()) == [("12", "a", 12), ("6", "a", 6), ("6", "b", 6)]


def test_constraints():
    from numbers import Real

    from lumenfold.functions import constraints as C

    part, whole = C.number(Real, 0, 1, "left"), C.number(Real, 0, 1)
    assert C.accepts(part, 0) and not C.accepts(part, 1) and not C.accepts(whole, True) and not C.accepts(whole, math.nan) and C.accepts(C.number(Real, None, 1, "neither"), -5)
    assert C.accepts("random state", 3) and not C.accepts("boolean", 1) and C.accepts(C.with_methods("append"), []) and C.accepts("missing", math.nan)
    C.check("x", {"a": [C.one_of("u", "v"), None]}, {"a": None, "b": 5})
    with pytest.raises(C.ParameterError, match="'u', 'v' or None"):
        C.check("x", {"a": [C.one_of("u", "v"), None, C.hidden(C.one_of("w2"))]}, {"a": "w"})
    with pytest.raises(ValueError):
        C.number(Real, 1, 0)
    with pytest.warns(FutureWarning):
        C.check("x", {"a": [C.deprecated(C.one_of("old")), None]}, {"a": "old"})


def test_checked_arguments():
    from numbers import Integral

    from lumenfold.functions import constraints as C

    @C.checked({"n": [C.number(Integral, 1)], "free": "no validation"})
    def twice(n, free=None):
        return 2 * n

    assert twice(3, free=object()) == 6
    with pytest.raises(C.ParameterError, match="at least 1"):
        twice(n=0)


def test_metric_names():
    assert {dist.metric_name(m) for m in ("l1", "cityblock", 1)} == {"manhattan"} and dist.metric_name("wminkowski") == "minkowski"
    a, b = np.array([[1.0, 0, 2, 0]]), np.array([[3.0, 1, 0, 0]])
    got = {m: float(dist.block_distance(a, b, m)[0, 0]) for m in dist.TRUTH}
    assert got == pytest.approx({"dice": 0.5, "jaccard": 2 / 3, "matching": 0.5, "rogerstanimoto": 2 / 3, "russellrao": 0.75, "sokalsneath": 0.8, "yule": 1.0})
    gaps = dist.block_distance(np.array([[1.0, np.nan]]), np.array([[4.0, 2.0]]), "nan_euclidean")
    assert gaps[0, 0] == pytest.approx(math.sqrt(18))
    assert dist.block_distance(np.array([[0.0, 0.0]]), np.array([[0.0, math.pi]]), "haversine")[0, 0] == pytest.approx(math.pi)
    for name in ("seuclidean", "mahalanobis"):
        with pytest.raises(ValueError):
            dist.block_distance(a, b, name)
