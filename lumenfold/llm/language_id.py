"""Language by multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams (1 to 4 characters, A-Z lower-cased) by language, smoothed, give a matrix of log-probabilities,
which is broadcast: 4 bytes for each bucket and language, MATRIX_BYTES at most, as many languages get fewer buckets. A batch
of texts is a sparse matrix, a row for each text with its n-grams' buckets, which is multiplied with it; texts are
taken whole, and the priors alike.

Learned from text and non-null lang of rows that are not held out: at most FIT_PER_LANG rows of a language and FIT_ROWS
in all, of at most FIT_CHARS characters each. A language whose texts are all longer is learned from about FIT_LONG of
them, read whole, whose n-grams are counted on the executors. Of more than MAX_LANGS languages, those with the most rows
to learn from are learned (ties: the first in order): a dirty lang column ends no query.

A text that is null or has no letter is `und` with score 0, and so is every text where nothing could be learned.
Equal scores go to the language first in sorted order. Rows that repeat get a row each; a null doc_id is predicted and
is not held out. Columns other than doc_id, text and lang, whatever their names, play no part. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, held_out, slices, small_batches, table
from .ngrams import NGrams, bounded_sample

ORDERS = 1, 2, 3, 4
BITS, MATRIX_BYTES = 16, 64 << 20
FIT_PER_LANG, FIT_ROWS, FIT_CHARS = 1000, 8000, 20_000
FIT_LONG = 20
MAX_LANGS = 4000
SMOOTH = 0.5
#: Products that are held at once.
CHUNK = 1 << 21
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Looks no further than the first letter; numbers such as fractions look like words but are no letters."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def buckets(n_langs: int) -> int:
    """Bits of a bucket, so that the matrix stays within MATRIX_BYTES."""
    return min(BITS, (MATRIX_BYTES // (4 * max(1, n_langs))).bit_length() - 1)


def fit(texts: list[str], langs: list[str], counted: pa.Table | None = None, bits: int = BITS) -> tuple[list[str], np.ndarray] | None:
    """Languages and the matrix of log-probabilities, a row for each bucket; `counted` has lang, bucket, n of further texts."""
    names = sorted({*langs, *(counted.column("lang").unique().to_pylist() if counted else ())})
    if not names:
        return None
    at = {name: i for i, name in enumerate(names)}
    counts = np.zeros((1 << bits, len(names)))
    for i in range(0, len(texts), 200):
        g = NGrams(pa.array(texts[i : i + 200], pa.string()), ORDERS, bits)
        for j, lang in enumerate(langs[i : i + 200]):
            x, n = np.unique(g.of(j), return_counts=True)
            counts[x, at[lang]] += n
    if counted:
        column = pc.index_in(counted.column("lang"), pa.array(names, pa.string()))
        np.add.at(counts, (counted.column("bucket").to_numpy(), column.to_numpy()), counted.column("n").to_numpy())
    counts += SMOOTH
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def log_likelihoods(g: NGrams, matrix: np.ndarray) -> np.ndarray:
    """For each text and language, the sum of its n-grams' log-probabilities: a sparse matrix times the dense one."""
    out = np.zeros((len(g.offsets) - 1, matrix.shape[1]))
    step = max(1, CHUNK // matrix.shape[1])
    for doc, bucket in g.each():
        for i in range(0, len(doc), step):
            d = doc[i : i + step]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            out[d[first]] += np.add.reduceat(matrix[bucket[i : i + step]].astype(np.float64), first, axis=0)
    return out


def predict(texts: pa.Array, model: tuple[list[str], np.ndarray] | None) -> tuple[list[str], list[float]]:
    """Language and its posterior probability for each text."""
    langs, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None or not len(texts):
        return langs, score
    names, matrix = model
    z = log_likelihoods(NGrams(texts, ORDERS, len(matrix).bit_length() - 1), matrix)
    best = np.argmax(z, axis=1)
    top = 1 / np.exp(z - z[np.arange(len(z)), best][:, None]).sum(axis=1)
    for i, text in enumerate(texts):
        if text.is_valid and has_letter(text.as_py()):
            langs[i], score[i] = names[int(best[i])], float(top[i])
    return langs, score


def _counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                x, n = np.unique(NGrams(pa.array([text.as_py()], pa.string()), ORDERS, bits).of(0), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    return run


def _sampled(texts: DataFrame, sample: DataFrame) -> DataFrame:
    return texts.join(F.broadcast(sample.distinct()), (texts["doc_id"] == sample["doc_id"]) & (F.col("lang") == F.col("y")), "left_semi")


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray] | None:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = texts.where("lang is not null and doc_id is not null and length(text) > 0").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").alias("y"), (F.length("text") <= FIT_CHARS).alias("short"))
    # Languages with the most rows, and whether they have a short text: MAX_LANGS rows.
    langs = known.groupBy("y").agg(F.count("*").alias("n"), F.max("short").alias("short")).orderBy(F.desc("n"), "y").limit(MAX_LANGS).collect()
    if not langs:
        return None
    bits, long = buckets(len(langs)), [r.y for r in langs if not r.short]
    sample, _ = bounded_sample(known.where("short").select("doc_id", "y"), "y", FIT_PER_LANG, FIT_ROWS, MAX_LANGS)
    counted = None
    if long:
        few, _ = bounded_sample(known.where(F.col("y").isin(long)).select("doc_id", "y"), "y", FIT_LONG, FIT_LONG * len(long), MAX_LANGS)
        counted = _sampled(texts.where(F.length("text") > FIT_CHARS), few).select("text", "lang").mapInArrow(_counter(bits), "lang string, bucket int, n long")
        counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    rows = _sampled(texts.where(F.length("text") <= FIT_CHARS), sample)
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(FIT_ROWS).select("text", "lang").toArrow()
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist(), counted, bits)


def _predictor(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs, score = predict(part.column("text"), model.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))
    got = doc_rows(docs).mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
