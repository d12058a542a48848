"""Scores of a labelling against a true one. Everything starts from the contingency table, which is small.

Input: columns `true` and `pred` (int). Noise (-1) is a label like any other in the agreement scores; purity and the
two perspectives leave it out on both sides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

NOISE = -1


def contingency(pairs: DataFrame) -> DataFrame:
    """true, pred, n."""
    return pairs.groupBy("true", "pred").agg(F.count("*").alias("n"))


def _margin(cells: DataFrame, by: str) -> DataFrame:
    return cells.groupBy(by).agg(F.sum("n").alias("n"))


def _entropy(n: Column, total: Column) -> Column:
    return -F.sum(n / total * F.log2(n / total))


def _choose2(n: Column) -> Column:
    """Pairs among n, as a double: products of counts overflow integers soon."""
    return n.cast("double") * (n.cast("double") - 1) / 2


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: n, ari, mi, h_true, h_pred (bits), nmi, homogeneity, completeness, v_measure, and the two that the native
    report has under swapped names. Scores without information are 0 (ari, nmi) or 1 (homogeneity, completeness)."""
    cells = contingency(pairs)
    total = cells.agg(F.sum("n").alias("total"))
    t, p = _margin(cells, "true"), _margin(cells, "pred")
    side = lambda m, s: m.crossJoin(F.broadcast(total)).agg(F.coalesce(_entropy(F.col("n"), F.col("total")), F.lit(0.0)).alias(f"h_{s}"), F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0.0)).alias(f"pairs_{s}"))
    inner = cells.join(t.withColumnRenamed("n", "nt"), "true").join(p.withColumnRenamed("n", "np"), "pred").crossJoin(F.broadcast(total))
    joint = F.col("n") / F.col("total")
    mi = F.sum(joint * F.log2(F.col("n").cast("double") * F.col("total") / (F.col("nt").cast("double") * F.col("np"))))
    cell = inner.agg(F.coalesce(mi, F.lit(0.0)).alias("mi"), F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0.0)).alias("pairs_both"))
    row = cell.crossJoin(F.broadcast(side(t, "true"))).crossJoin(F.broadcast(side(p, "pred"))).crossJoin(F.broadcast(total))
    expected = F.try_divide(F.col("pairs_true") * F.col("pairs_pred"), _choose2(F.col("total")))
    ari = F.try_divide(F.col("pairs_both") - expected, (F.col("pairs_true") + F.col("pairs_pred")) / 2 - expected)
    of = lambda h: F.when(F.col(h) > 0, F.col("mi") / F.col(h)).otherwise(F.lit(1.0))
    row = row.select(
        F.coalesce("total", F.lit(0)).cast("long").alias("n"), F.coalesce(ari, F.lit(0.0)).alias("ari"), "mi", "h_true", "h_pred",
        F.coalesce(F.try_divide(2 * F.col("mi"), F.col("h_true") + F.col("h_pred")), F.lit(0.0)).alias("nmi"),
        of("h_true").alias("homogeneity"), of("h_pred").alias("completeness"),
    )
    v = F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0))
    return row.withColumn("v_measure", v).withColumn("native_homogeneity", F.col("completeness")).withColumn("native_completeness", F.col("homogeneity"))


def three_way(labels: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """a, b, ari, nmi, v_measure of each two of three labellings (columns)."""
    out = None
    for a, b in ((0, 1), (0, 2), (1, 2)):
        row = agreement(labels.select(F.col(names[a]).alias("true"), F.col(names[b]).alias("pred"))).select(F.lit(names[a]).alias("a"), F.lit(names[b]).alias("b"), "ari", "nmi", "v_measure")
        out = row if out is None else out.unionByName(row)
    return out


def _greedy(cells: pd.DataFrame) -> pd.DataFrame:
    used, matched = set(), 0
    for _, own in cells.sort_values(["true", "n", "pred"], ascending=[True, False, True]).groupby("true", sort=True):
        free = own[~own["pred"].isin(used)]
        if len(free) and free["pred"].iloc[0] != NOISE:
            used.add(free["pred"].iloc[0])
            matched += int(free["n"].iloc[0])
    return pd.DataFrame({"matched": [matched], "n": [int(cells["n"].sum())]})


def matching_accuracy(pairs: DataFrame) -> DataFrame:
    """matched, n, accuracy: true labels in rising order each take their largest cluster that is still free (ties: the
    smaller id). One whose largest is noise gets nothing. The order makes this sequential: one task, over the contingency table."""
    got = contingency(pairs).groupBy().applyInPandas(_greedy, "matched bigint, n bigint")
    return got.select("matched", "n", F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("n").cast("double")), F.lit(0.0)).alias("accuracy"))


def purity(pairs: DataFrame) -> DataFrame:
    """pure, impure (clusters), noise (rows), purity (pure clusters to all). Noise is no cluster; a true -1 is no emitter."""
    cells = contingency(pairs)
    per = cells.where(F.col("pred") != NOISE).groupBy("pred").agg(F.sum((F.col("true") != NOISE).cast("int")).alias("k"))
    counts = per.agg(F.coalesce(F.sum((F.col("k") == 1).cast("long")), F.lit(0)).alias("pure"), F.count("*").alias("clusters"))
    noise = cells.agg(F.coalesce(F.sum(F.when(F.col("pred") == NOISE, F.col("n"))), F.lit(0)).alias("noise"))
    return counts.crossJoin(F.broadcast(noise)).select("pure", (F.col("clusters") - F.col("pure")).alias("impure"), "noise", F.coalesce(F.try_divide(F.col("pure").cast("double"), F.col("clusters").cast("double")), F.lit(0.0)).alias("purity"))


def _real(cells: DataFrame) -> DataFrame:
    """Cells without noise, with how many emitters each cluster holds."""
    real = cells.where((F.col("true") != NOISE) & (F.col("pred") != NOISE))
    return real.withColumn("emitters", F.count("*").over(Window.partitionBy("pred")))


def emitter_perspective(pairs: DataFrame) -> DataFrame:
    """true, kind, n_points, n_noise, n_clusters, coverage, distribution of each emitter.

    missing: in no cluster; perfect: in one, alone there; merged: some cluster of it holds another; broken_up: in several, alone.
    """
    cells = contingency(pairs)
    all_ = cells.where(F.col("true") != NOISE).groupBy("true").agg(F.sum("n").alias("n_points"), F.coalesce(F.sum(F.when(F.col("pred") == NOISE, F.col("n"))), F.lit(0)).alias("n_noise"))
    own = _real(cells).groupBy("true").agg(F.count("*").alias("n_clusters"), F.max("emitters").alias("most"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pred", "n")))).alias("distribution"))
    out = all_.join(own, "true", "left").withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0)))
    kind = F.when(F.col("n_clusters") == 0, "missing").when(F.col("most") > 1, "merged").when(F.col("n_clusters") == 1, "perfect").otherwise("broken_up")
    return out.select("true", kind.alias("kind"), "n_points", "n_noise", "n_clusters", ((F.col("n_points") - F.col("n_noise")) / F.col("n_points")).alias("coverage"), "distribution")


def cluster_perspective(pairs: DataFrame) -> DataFrame:
    """pred, kind, n_points, n_emitters, coverage (of its emitter, if pure), siblings (pure clusters of that emitter).

    false: no emitter; pure: one; impure: several. A pure cluster with siblings is broken_up.
    """
    cells = contingency(pairs)
    all_ = cells.where(F.col("pred") != NOISE).groupBy("pred").agg(F.sum("n").alias("n_points"), F.sum((F.col("true") != NOISE).cast("long")).alias("n_emitters"), F.max(F.when(F.col("true") != NOISE, F.struct("n", "true"))).alias("top"))
    size = cells.where(F.col("true") != NOISE).groupBy("true").agg(F.sum("n").alias("emitter_points"))
    out = all_.select("pred", "n_points", "n_emitters", F.when(F.col("n_emitters") == 1, F.col("top.true")).alias("true"), F.col("top.n").alias("own")).join(size, "true", "left")
    pure = F.col("n_emitters") == 1
    siblings = F.when(pure, F.count("*").over(Window.partitionBy("true")) - 1)
    out = out.withColumn("siblings", siblings)
    kind = F.when(F.col("n_emitters") == 0, "false").when(~pure, "impure").otherwise("pure")
    return out.select("pred", kind.alias("kind"), "n_points", "n_emitters", F.when(pure, F.col("own") / F.col("emitter_points")).alias("coverage"), "siblings", (pure & (F.col("siblings") > 0)).alias("broken_up"))


def quality_summary(pairs: DataFrame) -> DataFrame:
    """One row of counters: emitters and clusters by kind, correct and incorrect emitters, and correctness."""
    kinds = lambda df, names, pre: df.agg(*(F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0)).alias(f"{pre}_{k}") for k in names), F.count("*").alias(f"{pre}s"))
    e = kinds(emitter_perspective(pairs), ("missing", "perfect", "merged", "broken_up"), "emitter")
    c = kinds(cluster_perspective(pairs), ("false", "pure", "impure"), "cluster")
    out = e.crossJoin(F.broadcast(c))
    out = out.withColumn("correct", F.col("emitter_perfect") + F.col("emitter_broken_up")).withColumn("incorrect", F.col("emitter_merged") + F.col("emitter_missing"))
    return out.withColumn("correctness", F.coalesce(F.try_divide(F.col("correct").cast("double"), (F.col("correct") + F.col("incorrect")).cast("double")), F.lit(0.0)))


def basic_quality(labels: DataFrame, label: str = "label") -> DataFrame:
    """n_clusters, n_noise, noise_ratio."""
    noise = F.sum((F.col(label) == NOISE).cast("long"))
    return labels.agg(F.countDistinct(F.when(F.col(label) != NOISE, F.col(label))).alias("n_clusters"), F.coalesce(noise, F.lit(0)).alias("n_noise"), F.coalesce(F.try_divide(noise.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("noise_ratio"))


def cluster_summary(rows: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """label, name, n, share (percent), and mean, std (population), min, max of each column."""
    stats = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    total = rows.agg(F.count("*").alias("total"))
    out = rows.groupBy(label).agg(F.count("*").alias("n"), *stats).crossJoin(F.broadcast(total))
    name = F.when(F.col(label) == NOISE, F.lit("Noise")).otherwise(F.concat(F.lit("Cluster "), F.col(label).cast("string")))
    return out.select(label, name.alias("name"), "n", (F.col("n") * F.lit(100.0).cast("double") / F.col("total")).alias("share"), *(s for c in columns for s in (f"{c}_mean", f"{c}_std", f"{c}_min", f"{c}_max")))


def weighted_centroids(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """label, centroid: mean of the features, weighted by the membership strength."""
    rows = points.join(labelled.where(F.col("label") != NOISE), "row_id").select("label", "probability", F.posexplode("features").alias("i", "x"))
    parts = rows.groupBy("label", "i").agg(F.try_divide(F.sum(F.col("x") * F.col("probability")), F.sum("probability")).alias("c"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centroid"))


def weighted_medoids(points: DataFrame, labelled: DataFrame, metric="euclidean") -> DataFrame:
    """label, row_id, features of the point whose distances to the others, weighted by their strengths, sum to the least.

    Distances within a cluster are taken in blocks: each task sums one block's distances to another's.
    """
    import numpy as np

    from ..functions.distance import block_distance

    block = 2048
    rows = points.join(labelled.where(F.col("label") != NOISE), "row_id").select("label", "row_id", "features", "probability")
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = rows.join(sizes, "label").withColumn("b", F.pmod(F.xxhash64("row_id"), "parts").cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = written(dealt, "medoid-blocks")
    a = dealt.withColumn("o", F.explode(every)).select("label", F.col("b").alias("x"), F.col("o").alias("y"), "row_id", "features")
    b = dealt.withColumn("o", F.explode(every)).select("label", F.col("o").alias("x"), F.col("b").alias("y"), "row_id", "features", "probability")

    def cost(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"label": pd.Series(dtype="int32"), "row_id": pd.Series(dtype="int64"), "cost": pd.Series(dtype="float64")})
        d = block_distance(np.array(left["features"].tolist()), np.array(right["features"].tolist()), metric)
        return pd.DataFrame({"label": left["label"], "row_id": left["row_id"], "cost": d @ right["probability"].to_numpy()})

    costs = a.groupBy("label", "x", "y").cogroup(b.groupBy("label", "x", "y")).applyInPandas(cost, "label int, row_id bigint, cost double").groupBy("label", "row_id").agg(F.sum("cost").alias("cost"))
    best = costs.groupBy("label").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "row_id"))["row_id"].alias("row_id"))
    found = points.select(F.col("row_id").alias("id"), F.col("features").alias("x"))
    return best.join(found, F.col("row_id") == F.col("id")).select("label", "row_id", F.col("x").alias("features"))
