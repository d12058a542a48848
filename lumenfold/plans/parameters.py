"""Epsilon and min_samples of each file of a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scaling
from ..operators import dbscan as D
from ..sources import tables as S
from ..storage import written
from .estimator import DensityGrouping


def estimate(df: DataFrame, id_col: str, columns: Sequence[str], min_cluster_size: int = 5) -> tuple[int, float]:
    """(min_samples, eps) of one table, on z-scored columns: the most stable k, and the elbow of its distances."""
    rows = written(scaling.z_score(df.select(id_col, *(F.col(c).cast("double").alias(c) for c in columns)).dropna(), columns), "estimate-rows")
    points = written(scaling.features(rows, id_col, columns), "estimate-points")
    k, _ = D.choose_min_samples(points, lambda k: DensityGrouping(min_cluster_size, k).fit(rows, id_col, columns).clusters)
    return k, float(D.estimated_eps(points, k).first().eps)


def estimate_folder(spark: SparkSession, path: str, columns: Sequence[str], min_cluster_size: int = 5) -> DataFrame:
    """name, min_samples, eps of each CSV file; files are taken one after the other, each in parallel."""
    everything = S.read_folder(spark, path)
    if missing := set(columns) - set(everything.columns):
        raise ValueError(f"columns: {sorted(missing)}")
    rows = written(everything.select("file", *columns).withColumn("row_id", F.monotonically_increasing_id()), "folder")
    out = []
    for name in sorted(r.file for r in rows.select("file").distinct().collect()):
        k, eps = estimate(rows.where(F.col("file") == name), "row_id", columns, min_cluster_size)
        out.append((name.removesuffix(".csv"), k, eps))
    return spark.createDataFrame(out, "name string, min_samples int, eps double")
