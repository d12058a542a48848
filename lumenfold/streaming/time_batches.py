"""Greedy time batches over a stream: the anchor of each group is kept as state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "batch bigint, start_time double, end_time double, n bigint"
STATE = "batch bigint, start_time double, end_time double, n bigint"


def stream_batches(stream: DataFrame, group: str, time: str, interval: float = 2.0) -> DataFrame:
    """A row for each batch that a later row of its group has closed, in append mode.

    Rows of a micro-batch are taken in order of time. A row that comes late, before the anchor of the open batch, counts
    to that batch; its times are not moved back. The open batch of each group stays in the state until a row closes it.
    """
    interval = interval if interval > 0 else 2.0
    kind = stream.schema[group].dataType.simpleString()
    rows = stream.where(F.col(time).isNotNull()).select(group, F.col(time).cast("double").alias("t"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        closed = []
        for t in sorted(t for pdf in frames for t in pdf["t"]):
            if now is None:
                now = [0, t, t, 1]
            elif t > now[1] + interval:
                closed.append((*key, *now))
                now = [now[0] + 1, t, t, 1]
            else:
                now[2], now[3] = max(now[2], t), now[3] + 1
        if now is not None:
            state.update(tuple(now))
        yield pd.DataFrame(closed, columns=[group, "batch", "start_time", "end_time", "n"])

    return rows.groupBy(group).applyInPandasWithState(step, f"`{group}` {kind}, {OUTPUT}", STATE, "append", GroupStateTimeout.NoTimeout)
