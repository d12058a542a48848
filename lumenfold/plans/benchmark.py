"""Running several groupings over several batches, with times and scores."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..storage import written

RESULT = "batch string, algorithm string, samples bigint, emitters bigint, seconds double, clusters bigint, correct bigint, incorrect bigint, ari double, nmi double, v_measure double, timeout boolean"


def timed(spark: SparkSession, run: Callable[[], DataFrame], seconds: float | None = None) -> tuple[DataFrame | None, float]:
    """What run() returns, written, and its time; None if it took longer, whereupon its Spark jobs are cancelled."""
    tag, began = f"timed-{time.monotonic_ns()}", time.monotonic()
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop) if seconds else None
    spark.sparkContext.addJobTag(tag)
    try:
        if timer:
            timer.start()
        return written(run(), "timed"), time.monotonic() - began
    except Exception:
        if not late.is_set():
            raise
        return None, time.monotonic() - began
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def run_batches(batches: Sequence[tuple[str, DataFrame]], algorithms: dict[str, Callable[[DataFrame], DataFrame]], truth: str, id_col: str = "row_id", seconds: float | None = 300.0) -> DataFrame:
    """RESULT rows: each algorithm (rows -> row_id, label) on each batch (with columns id_col and truth)."""
    spark = batches[0][1].sparkSession
    out = []
    for name, rows in batches:
        samples, emitters = rows.agg(F.count("*"), F.countDistinct(truth)).first()
        for algorithm, run in algorithms.items():
            labels, took = timed(spark, lambda run=run, rows=rows: run(rows), seconds)
            if labels is None:
                out.append((name, algorithm, samples, emitters, took, None, None, None, None, None, None, True))
                continue
            pairs = written(rows.select(F.col(id_col).alias("row_id"), F.col(truth).cast("int").alias("true")).join(labels.select("row_id", F.col("label").alias("pred")), "row_id"), "scored")
            a, q, b = M.agreement(pairs).first(), M.quality_summary(pairs).first(), M.basic_quality(pairs, "pred").first()
            out.append((name, algorithm, samples, emitters, took, b.n_clusters, q.correct, q.incorrect, a.ari, a.nmi, a.v_measure, False))
    return spark.createDataFrame(out, RESULT)


def run_sizes(rows: DataFrame, sizes: Sequence[int], algorithms: dict[str, Callable[[DataFrame], DataFrame]], truth: str, id_col: str = "row_id", seconds: float | None = 300.0, most: dict[str, int] | None = None) -> DataFrame:
    """RESULT rows for the rows of the smallest ids, at each size; `most` leaves an algorithm out beyond a size."""
    out = None
    for size in sizes:
        able = {k: f for k, f in algorithms.items() if size <= (most or {}).get(k, size)}
        batch = written(rows.orderBy(id_col).limit(size), "size")
        got = run_batches([(str(size), batch)], able, truth, id_col, seconds) if able else None
        out = got if out is None else out.unionByName(got) if got is not None else out
    return out


def means(results: DataFrame) -> DataFrame:
    """Of each algorithm: runs, completed, and mean seconds and scores over the completed runs."""
    done = ~F.col("timeout")
    return results.groupBy("algorithm").agg(F.count("*").alias("runs"), F.sum(done.cast("long")).alias("completed"), *(F.avg(F.when(done, F.col(c))).alias(f"mean_{c}") for c in ("seconds", "ari", "nmi", "v_measure", "correct")))


def predicted_seconds(sizes: Sequence[float], seconds: Sequence[float], size: float) -> float | None:
    """Time at a size: a quadratic through the measured ones if that gives 0 to 7200 s, else the last two's line, 0 at least."""
    if len(sizes) < 2:
        return None
    if len(sizes) > 2:
        y = float(np.polyval(np.polyfit(sizes, seconds, 2), size))
        if 0 < y < 7200:
            return y
    (x0, x1), (y0, y1) = sizes[-2:], seconds[-2:]
    return max(0.0, y1 + (y1 - y0) / (x1 - x0) * (size - x1)) if x1 != x0 else max(0.0, float(y1))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, and the sums of components and of their products, of a partition: bounded by the square of the dimensions."""
    n, total, products = 0, None, None
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column("features").to_pylist(), dtype=float)
            n, total, products = n + len(x), x.sum(axis=0) + (0 if total is None else total), x.T @ x + (0 if products is None else products)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], ["n", "total", "products"])


def project(points: DataFrame, dims: int = 2) -> DataFrame:
    """row_id, pc: principal components of the centred features; each one's largest loading is positive."""
    added = points.select("features").mapInArrow(_sums, "n bigint, total array<double>, products array<double>")
    entry = lambda c: added.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow().column("x").to_numpy()
    n, mean, products = added.agg(F.sum("n")).first()[0], entry("total"), entry("products")
    mean = mean / n
    cov = products.reshape(len(mean), -1) / n - np.outer(mean, mean)
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :dims].T
    vectors = [v * np.sign(v[np.argmax(np.abs(v))]) for v in vectors]
    centred = F.zip_with("features", F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    part = lambda v: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, v.tolist())), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return points.select("row_id", F.array(*map(part, vectors)).alias("pc"))
