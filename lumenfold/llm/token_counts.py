"""Token counts through a digest cache.

A document's content digest and the tokenizer file's digest are looked up in a stored table of counts. Only contents
that the table lacks are encoded, one document for each, and their counts are appended to it.

Content is taken as it is: any change of letters or spaces could change a count. A null text counts as empty. Rows
that repeat a doc_id or a text each get a row; a text that many rows repeat is broadcast with its count rather than
joined. Other columns, whatever their names, are left. An empty table gives an empty result.

The cache is partitioned by tokenizer version, so that a run reads the counts of its own only. The query keeps its
cache in the folder named by CACHE_SETTING, for the next run; where that is unset, it begins with an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import doc_rows, hot_join, shared_path, table, written

#: Session setting that names the folder of the query's cache.
CACHE_SETTING = "spark.lumenfold.tokenCache"
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
LIMIT = 1024


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.load(path)
        for batch in batches:
            counts = [len(tokenizer.ids(t)) for t in map(pa.StringScalar.as_py, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


class DigestCache:
    """Counts stored as Parquet at `path`, appended to by each call; a path that has no table yet is an empty cache."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: str) -> DataFrame:
        """digest, n_tokens of one tokenizer version; appends of runs at the same time may repeat a digest."""
        try:
            stored = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = self.spark.createDataFrame([], CACHE_SCHEMA)
        return stored.where(F.col("tokenizer") == version).select("digest", "n_tokens")

    def append(self, version: str, counts: DataFrame) -> None:
        counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(self.path)


def count_tokens(docs: DataFrame, cache_path: str | None = None, tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs. Without a cache_path the cache is new."""
    spark = docs.sparkSession
    path = tokenizer_path or bpe.default_path()
    version = bpe.version(path)
    cache = DigestCache(spark, cache_path or shared_path(spark, "token-cache"))
    keyed = doc_rows(docs).withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    keys = written(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")

    # One row stands for each missing content; only its text moves. A null id stands where there is no other.
    distinct = written(keys.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "token-digests")
    missing = distinct.join(cache.read(version), "digest", "left_anti")
    rep = missing.select(F.col("digest").alias("rep_digest"), "rep").hint("shuffle_hash")
    todo = keyed.join(rep, (F.col("digest") == F.col("rep_digest")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    counted = todo.select("digest", "text").mapInArrow(_encoder(path), "digest binary, n_tokens long")
    cache.append(version, counted)

    counts = written(cache.read(version).join(distinct.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "token-counts")
    joined = hot_join(keys, counts, "digest", distinct.select("digest", "n"), keys.count())
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), spark.conf.get(CACHE_SETTING, None))
