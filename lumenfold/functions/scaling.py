"""Scaling, jitter and column weights: one pass for the statistics, then column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_stats(df: DataFrame, aggregates: list[Column]) -> DataFrame:
    """df with one row of statistics beside each of its rows; the row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column to [0, 1]; a constant one to 0."""
    stats = [f(F.col(c).cast("double")).alias(f"__{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    out = _with_stats(df, stats)
    scaled = {c: F.when(F.col(f"__hi_{i}") > F.col(f"__lo_{i}"), (F.col(c) - F.col(f"__lo_{i}")) / (F.col(f"__hi_{i}") - F.col(f"__lo_{i}"))).when(F.col(c).isNotNull(), F.lit(0.0)) for i, c in enumerate(columns)}
    return out.withColumns(scaled).select(*df.columns)


def z_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column less its mean, over its population deviation; a constant one is only centred."""
    stats = [f(F.col(c).cast("double")).alias(f"__{n}_{i}") for i, c in enumerate(columns) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    out = _with_stats(df, stats)
    scaled = {c: (F.col(c) - F.col(f"__mean_{i}")) / F.when(F.col(f"__sd_{i}") > 0, F.col(f"__sd_{i}")).otherwise(F.lit(1.0)) for i, c in enumerate(columns)}
    return out.withColumns(scaled).select(*df.columns)


def linear(df: DataFrame, columns: Sequence[str], matrix: Sequence[Sequence[float]]) -> DataFrame:
    """The columns, as a row vector, times a square matrix."""
    made = {c: sum((F.col(r) * float(matrix[i][j]) for i, r in enumerate(columns)), F.lit(0.0)) for j, c in enumerate(columns)}
    return df.withColumns(made)


def _normal(seed: int, keys: Sequence[str]) -> Column:
    """Standard normal noise that depends on the row's keys alone, from two uniform numbers of its hash."""
    uniform = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def jitter(df: DataFrame, deviations: Mapping[str, float], seed: int = 42, not_negative: Sequence[str] = ("PW(microsec)",), row_id: Sequence[str] = ()) -> DataFrame:
    """Gaussian noise on columns; where a column that can't be negative would become so, it stays as it was.

    With row_id, columns that tell rows apart, the noise is the same however the table is partitioned.
    """
    if unknown := set(deviations) - set(df.columns):
        raise ValueError(f"columns: {sorted(unknown)}")
    noisy = {c: F.col(c) + F.lit(float(sd)) * (_normal(seed + i, row_id) if row_id else F.randn(seed + i)) for i, (c, sd) in enumerate(deviations.items())}
    return df.withColumns({f"__{c}": x for c, x in noisy.items()}).withColumns({c: F.when(F.col(f"__{c}") < 0, F.col(c)).otherwise(F.col(f"__{c}")) if c in not_negative else F.col(f"__{c}") for c in noisy}).select(*df.columns)


def std_range_weights(df: DataFrame, deviations: Mapping[str, float], tolerance: float = 0.2) -> DataFrame:
    """column, weight: robust range over the known deviation, summing to 1.

    The range is p90 - p10, or p75 - p25 where the two differ by more than the tolerance (of the larger).
    """
    if any(sd == 0 for sd in deviations.values()):
        raise ValueError("deviations: none may be 0")
    q = [F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, (0.1, 0.25, 0.75, 0.9)))).alias(f"q{i}") for i, c in enumerate(deviations)]
    rows = df.agg(*q).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"q{i}").alias("q"), F.lit(float(sd)).alias("sd")) for i, (c, sd) in enumerate(deviations.items())))).alias("s")).select("s.*")
    r90, r75 = F.col("q")[3] - F.col("q")[0], F.col("q")[2] - F.col("q")[1]
    apart = F.try_divide(F.abs(r90 - r75), F.greatest(r90, r75)) > tolerance
    rows = rows.select("column", (F.when(apart, r75).otherwise(r90) / F.col("sd")).alias("raw"))
    total = rows.agg(F.sum("raw").alias("total"))
    return rows.crossJoin(total).select("column", F.try_divide("raw", "total").alias("weight"))


def inverse_std_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, weight: 1 over the population deviation, summing to 1; a constant column has weight 0."""
    rows = df.agg(*(F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)))
    rows = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.try_divide(F.lit(1.0), F.col(f"s{i}")), F.lit(0.0)).alias("raw")) for i, c in enumerate(columns)))).alias("s")).select("s.*")
    return rows.crossJoin(rows.agg(F.sum("raw").alias("total"))).select("column", F.try_divide("raw", "total").alias("weight"))


def features(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """row_id, features: rows with a null in a column are left out."""
    cols = [F.col(c).cast("double") for c in columns]
    return df.dropna(subset=[id_col, *columns]).select(F.col(id_col).cast("long").alias("row_id"), F.array(*cols).alias("features"))
