"""Written tables in the folder that driver and executors share, and places in an order that no one task has to hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDER = "lumenfold"


def shared_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir. Where it is unset, a new temporary one in local mode; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix=f"{FOLDER}-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    # With its file system named, executors' own readers and writers find the same place as Spark's.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{FOLDER}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back: its lineage ends there, and it outlives executors.

    A small one (ids, pairs) is written by two tasks a core, or one for each four shuffle partitions where these are many,
    rather than in a file for each shuffle partition.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    if small:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "written_path", None):
            drop_path(t.sparkSession, path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys whose groups take long for their size: small shuffle partitions are otherwise put together in few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place from 0 on, by columns that tell all rows apart.

    Places are counted within range partitions, whose sizes are added up, rather than in one sorted partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row for each partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__part", "__own", "__before")
