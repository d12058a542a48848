"""Command line: group the rows of a CSV file and print or write the labels."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import metric_name
from .operators import metrics as M
from .plans.estimator import DensityGrouping
from .sources import tables as S
from .storage import written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lumenfold")
    p.add_argument("--input", required=True, help="CSV file or folder with a header")
    p.add_argument("--dimensions", type=int, required=True)
    p.add_argument("--minpts", type=int, default=2)
    p.add_argument("--min-cluster-size", type=int, default=20)
    p.add_argument("--metric", default="euclidean", help="a name, or 1 to 5")
    p.add_argument("--minkowski", type=float, default=2.0)
    p.add_argument("--method", choices=("eom", "leaf"), default="eom")
    p.add_argument("--profile", choices=("native", "standard"), default="native")
    p.add_argument("--epsilon", type=float, default=0.0)
    p.add_argument("--weights", type=float, nargs="*")
    p.add_argument("--skip-columns", type=lambda s: [int(x) for x in s.split(",")], default=[])
    p.add_argument("--skip-toa", action="store_true", help="leave out column 0")
    p.add_argument("--skip-amp", action="store_true", help="leave out column 3")
    p.add_argument("--no-norm", action="store_true")
    p.add_argument("--labelled", action="store_true", help="the last column is the true label: scores are printed")
    p.add_argument("--output", help="folder for the labels; else their counts are printed")
    return p


def run(spark: SparkSession, args: Sequence[str] | None = None) -> DataFrame:
    """row_id, label, probability of the file's rows."""
    a = parser().parse_args(args)
    skip = {*a.skip_columns, *([0] if a.skip_toa else []), *([3] if a.skip_amp else [])}
    rows = S.with_row_id(S.read_pulses(spark, a.input, skip=sorted(skip), label=a.labelled, dimensions=a.dimensions), lambda df: written(df, "input"))
    columns = [c for c in rows.columns if c not in ("row_id", "label")]
    metric = metric_name(int(a.metric) if a.metric.isdigit() else a.metric)
    grouping = DensityGrouping(a.min_cluster_size, a.minpts, a.epsilon, metric=metric, p=a.minkowski, weights=a.weights, cluster_selection_method=a.method, profile=a.profile, normalise=False if a.no_norm else None)
    labels = grouping.fit_predict(rows, columns=columns)
    if a.labelled:
        pairs = rows.select("row_id", F.col("label").alias("true")).join(labels.select("row_id", F.col("label").alias("pred")), "row_id")
        M.agreement(pairs).show(truncate=False)
        M.matching_accuracy(pairs).show()
    if a.output:
        labels.write.option("header", True).csv(a.output)
    else:
        S.label_line(labels).orderBy("label").show(1000)
    return labels


if __name__ == "__main__":
    run(SparkSession.builder.appName("lumenfold").getOrCreate())
