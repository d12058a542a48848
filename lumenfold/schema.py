"""Column types of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Rows are told apart by row_id; parquet and CSV files keep no order.
POINT = "row_id bigint, features array<double>"
KNN = "u bigint, v bigint, dist double, rank int"
EDGE = "u bigint, v bigint, w double"
HIERARCHY = "component bigint, node bigint, left bigint, right bigint, dist double, size bigint, parent bigint"
CONDENSED = "component bigint, parent bigint, child bigint, lambda double, size bigint"
CLUSTER = "component bigint, cluster bigint, stability double, size bigint, children array<bigint>, selected boolean"
LABEL = "row_id bigint, label int, probability double"

#: Columns of a pulse table and their types, in no given order but for the label, which comes last.
PULSE = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("TOA(ns)", "PW(microsec)", "FREQ(MHz)", "Amp_S0(dBm)", "AZ_S0(deg)", "EL_S0(deg)", "Latitude(deg)", "Longitude(deg)")]
    + [T.StructField("EmitterId", T.IntegerType())]
)
