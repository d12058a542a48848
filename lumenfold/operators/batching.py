"""Samples and batches of a table of sources (emitters) and times."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Rows of each group."""
    return df.groupBy(group).agg(F.count("*").alias("n"))


def group_stats(df: DataFrame, group: str) -> DataFrame:
    """n_groups, min_rows, max_rows, mean_rows over groups."""
    return group_sizes(df, group).agg(F.count("*").alias("n_groups"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("mean_rows"))


def distinct_groups(df: DataFrame, group: str) -> DataFrame:
    """n_groups: how many groups there are, exactly."""
    return df.agg(F.countDistinct(group).alias("n_groups"))


def by_time(df: DataFrame, time: str, row_id: str) -> DataFrame:
    """The rows in order of time, ties by row_id, over range partitions."""
    return df.orderBy(time, row_id)


def _in_order(df: DataFrame, group: str, row_id: str, most: int, least: int = 1) -> DataFrame:
    """The first `most` groups, by first appearance, of those with at least `least` rows, with their place from 1 on."""
    firsts = df.groupBy(group).agg(F.min(row_id).alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)
    firsts = firsts.orderBy("first").limit(most)
    return written(firsts.withColumn("place", F.row_number().over(Window.orderBy("first"))).select(group, "place"), "groups", small=True)  # `most` rows


def fixed_sample(df: DataFrame, n_groups: int, most: int, group: str, time: str, row_id: str) -> DataFrame:
    """The earliest most // n_groups rows of each of the first n_groups groups that have as many; ties by row_id.

    Raises if that is less than a row, or if there are fewer such groups.
    """
    per = most // n_groups
    if per < 1:
        raise ValueError(f"{most} rows of {n_groups} groups: less than one each")
    chosen = _in_order(df, group, row_id, n_groups, per)
    if (found := chosen.count()) < n_groups:
        raise ValueError(f"{found} groups have {per} rows; {n_groups} are asked for")
    rows = df.join(chosen.select(group), group, "left_semi")
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(time, row_id))).where(F.col("__rank") <= per).drop("__rank")


def first_groups(df: DataFrame, sizes: Sequence[int], group: str, row_id: str) -> DataFrame:
    """The rows of the first N groups, for each N of sizes, with N in column `batch`; batches overlap."""
    places = _in_order(df, group, row_id, max(sizes))
    if max(sizes) > (found := places.count()):
        raise ValueError(f"{found} groups; {max(sizes)} are asked for")
    top = places.withColumn("batch", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda n: n >= F.col("place"))))
    return df.join(top.select(group, "batch"), group)


BATCHES = "batch bigint, start_time double, end_time double, n bigint"


def greedy_batches(df: DataFrame, group: str, time: str, interval: float = 2.0) -> DataFrame:
    """group, batch (from 0), start_time, end_time, n: the first row anchors a batch, and the first row more than `interval`
    after the anchor begins the next. An interval of 0 or less means 2.

    Where a batch ends depends on where it began, so the rows of a group are folded in order. They come sorted and in
    batches of rows; a task holds a few sums for its group, not the group, and looks up each batch's end in the sorted times.
    """
    interval = interval if interval > 0 else 2.0
    kind = df.schema[group].dataType
    rows = df.where(F.col(time).isNotNull()).select(group, F.col(time).cast("double").alias("t"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, group).sortWithinPartitions(group, "t")

    def fold(frames):
        key, state = None, None  # state: batch, start, end, n
        for pdf in frames:
            out = []
            g, t = pdf[group].to_numpy(), pdf["t"].to_numpy()
            codes = pd.factorize(pdf[group], use_na_sentinel=False)[0]
            for i, j in zip(cuts := [0, *np.flatnonzero(np.diff(codes)) + 1], [*cuts[1:], len(t)], strict=True):
                if i == j:
                    continue
                if state is None or not (g[i] == key or pd.isna(g[i]) and pd.isna(key)):
                    if state:
                        out.append((key, *state))
                    key, state = g[i], [0, t[i], t[i], 0]
                while True:  # a step for each batch, not for each row
                    end = i + int(np.searchsorted(t[i:j], state[1] + interval, side="right"))
                    if end > i:
                        state[2], state[3] = t[end - 1], state[3] + end - i
                    if end == j:
                        break
                    out.append((key, *state))
                    state, i = [state[0] + 1, t[end], t[end], 0], end
            yield pd.DataFrame(out, columns=[group, "batch", "start_time", "end_time", "n"])
        if state:
            yield pd.DataFrame([(key, *state)], columns=[group, "batch", "start_time", "end_time", "n"])

    return dealt.mapInPandas(fold, f"`{group}` {kind.simpleString()}, {BATCHES}")


def batch_configs(batches: DataFrame, data_type: str, path: str) -> DataFrame:
    """A configuration row for each batch: name, data_type, data_path, sample_size, batch_number, time_range."""
    return batches.select(
        F.concat(F.lit("Data_Batch_"), F.col("batch").cast("string"), F.lit("_"), F.col("n").cast("string"), F.lit("_samples")).alias("name"),
        F.lit(data_type).alias("data_type"), F.lit(path).alias("data_path"), F.col("n").alias("sample_size"), F.col("batch").alias("batch_number"),
        F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end")).alias("time_range"),
    )
