"""Shared folder, written tables and batch helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import drop_path, shared_path, shared_root  # noqa: F401

#: Largest value, in bytes, that an operator broadcasts or collects at once.
BROADCAST_BYTES = 64 << 20
#: Text that goes to Python at once.
BATCH_BYTES = 8 << 20
#: Least share of a table's rows, as 1 / HOT, that makes a join key hot.
HOT = 1024
#: Rows held out of every fit: crc32(doc_id as text) mod 3 is HELD_OUT.
HELD_OUT = 1


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most: with long texts, batches of the default size fill an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return what the driver's Python has freed to the system; where the C library has no such call, nothing."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(spark: SparkSession) -> None:
    """Give back the memory of a stage that is over, in the driver's Python and its JVM, which otherwise keeps the most it ever used."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back."""
    small_batches(df.sparkSession)
    return storage.written(df, label, small)


def hot_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """left joined with right (one row for each key), where a key may hold many of left's rows.

    sizes: key and its number n of left's rows; total: all of them. Keys of at least a HOT-th of all rows, of which there
    are at most HOT, are broadcast; only the rows of the others are moved. A null key meets nothing.
    """
    hot = sizes.where((F.col("n") * HOT >= total) & F.col(key).isNotNull()).select(key)
    few = right.join(F.broadcast(hot), key, "left_semi").withColumn("__hot", F.lit(True))
    marked = left.join(F.broadcast(few), key, "left")
    done = marked.where(F.col("__hot").isNotNull() | F.col(key).isNull()).drop("__hot") if how == "left" else marked.where("__hot").drop("__hot")
    rest = left.join(F.broadcast(hot), key, "left_anti")
    return done.unionByName((rest.where(F.col(key).isNotNull()) if how == "left" else rest).join(right, key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == HELD_OUT, F.lit(False))


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), a null text as an empty one; other columns, whatever their names, are left."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about max_bytes of the text column; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > max_bytes:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield batch.slice(first)
