"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct hashed n-grams (ORDERS characters long, A-Z lower-cased). Each is scaled by the log
of the ratio of its smoothed share among toxic and among other rows; a logistic model is fitted on the FEATURES scaled
n-grams whose shares of rows differ most, in standard errors. There is no least difference: few rows give few features,
but never none. Log-odds are moved from the fitted sample's class shares to those of all rows to learn from.

Learned from labelled rows that are not held out, on at most FIT_ROWS rows, FIT_PER_CLASS of a class. Whole texts are
fitted; a text of more than FIT_CHARS characters is only fitted where its class has none shorter. The settings below were chosen by
`cross_validated` among rows to learn from; held-out rows took no part. All texts are scored whole, in their own
tasks; only the weights are broadcast (4 bytes for each of 2^BITS buckets).

A null text is scored as an empty one: by the intercept. A doc_id with several labels is toxic if one of them says so;
null labels and labels of unknown documents are not used. Without rows of both classes every score is 0. Rows that
repeat get a row each; a null doc_id is scored and not held out. Other columns of docs, whatever their names, play no
part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, give_back, held_out, slices, small_batches, table
from .ngrams import NGrams, bounded_sample

BITS = 19
FIT_PER_CLASS, FIT_ROWS, FIT_CHARS, FIT_LONG = 3000, 6000, 20_000, 40
THRESHOLD = 0.7
STEPS, RATE = 120, 0.05


@dataclass(frozen=True)
class Settings:
    """Lengths of n-grams; most features; what is added to counts; weight of the squared weights."""

    orders: tuple[int, ...] = (4, 5, 6)
    features: int = 1000
    smooth: float = 1.0
    ridge: float = 1e-3


SETTINGS = Settings()
Model = tuple[np.ndarray, float, tuple[int, ...]]


def _features(texts: list[str], orders: tuple[int, ...], used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of the used features, in batches of texts: all features of all rows take much more room than those used."""
    for i in range(0, len(texts), 200):
        row, bucket = NGrams(pa.array(texts[i : i + 200], pa.string()), orders, BITS).distinct(used)
        yield row + i, bucket


def fit(texts: list[str], toxic: np.ndarray, prior: float | None = None, settings: Settings = SETTINGS) -> Model | None:
    """Weights by bucket, the intercept and the orders; prior: share of toxic rows where the model is used."""
    if len(set(toxic.tolist())) < 2:
        return None
    size, y = 1 << BITS, toxic.astype(np.float64)
    n_one, n_zero = y.sum(), len(y) - y.sum()
    one, zero = np.zeros(size), np.zeros(size)
    for row, bucket in _features(texts, settings.orders, np.ones(size, dtype=bool)):
        one += np.bincount(bucket, weights=y[row], minlength=size)
        zero += np.bincount(bucket, weights=1 - y[row], minlength=size)
    ratio = np.log((one + settings.smooth) / (one + settings.smooth).sum()) - np.log((zero + settings.smooth) / (zero + settings.smooth).sum())
    spread = np.abs(one / n_one - zero / n_zero) / np.sqrt((one + zero + 1) / len(y) * (1 / n_one + 1 / n_zero))
    place = np.flatnonzero(one + zero)
    place = np.sort(place[np.argsort(-spread[place], kind="stable")[: settings.features]])
    used = np.zeros(size, dtype=bool)
    used[place] = True
    parts = list(_features(texts, settings.orders, used))
    row, col = np.concatenate([r for r, _ in parts]), np.searchsorted(place, np.concatenate([b for _, b in parts]))
    scale = ratio[place]
    w, b = np.full(len(place), 1e-3), 0.0
    m, v, mb, vb = np.zeros(len(place)), np.zeros(len(place)), 0.0, 0.0
    each = np.where(y == 1, 0.5 / n_one, 0.5 / n_zero)
    for t in range(1, STEPS + 1):  # Adam on all rows, the classes weighing alike
        z = np.bincount(row, weights=(w * scale)[col], minlength=len(y)) + b
        error = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g, gb = np.bincount(col, weights=error[row], minlength=len(place)) * scale + settings.ridge * w, float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = RATE * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * (1 - t / (STEPS + 1))
        w -= rate * m / (np.sqrt(v) + 1e-6)
        b -= rate * mb / (np.sqrt(vb) + 1e-6)
    weights = np.zeros(size, dtype=np.float32)
    weights[place] = w * scale
    return weights, b + (0.0 if prior is None else float(np.log(prior / (1 - prior)))), settings.orders


def cross_validated(texts: list[str], toxic: np.ndarray, settings: Settings, folds: int = 3) -> dict[str, float]:
    """Log-loss, and recall and precision at THRESHOLD, of rows scored by models that were fitted without their fold."""
    fold, got = np.arange(len(texts)) % folds, np.empty(len(texts))
    for k in range(folds):
        here = np.flatnonzero(fold != k)
        model = fit([texts[i] for i in here], toxic[here], float(toxic[here].mean()), settings)
        out = np.flatnonzero(fold == k)
        got[out] = scores(pa.array([texts[i] for i in out], pa.string()), model)
    p = np.clip(got, 1e-6, 1 - 1e-6)
    loss = -np.mean(np.where(toxic == 1, np.log(p), np.log(1 - p)))
    hit = got >= THRESHOLD
    return {"log_loss": float(loss), "recall": float(hit[toxic == 1].mean()), "precision": float(toxic[hit].mean()) if hit.any() else 0.0}


def learnable(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[str], np.ndarray, float] | None:
    """Texts and classes of the sample to fit on, and the share of toxic rows among all rows to learn from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = doc_rows(docs)
    sizes = texts.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.min("n").alias("n"))
    known = known.join(sizes, "doc_id").withColumn("long", F.col("n") > FIT_CHARS)
    counts = {(r.y, r.long): r.n for r in known.groupBy("y", "long").agg(F.count("*").alias("n")).collect()}
    totals = [sum(n for (k, _), n in counts.items() if k == y) for y in (0, 1)]
    if not all(totals):
        return None
    # A class that has long texts only is fitted on a few of them, which are read whole.
    long = [y for y in (0, 1) if (y, False) not in counts]
    fits = known.where(~F.col("long") | F.col("y").isin(long))
    sample, _ = bounded_sample(fits, "y", FIT_LONG if long else FIT_PER_CLASS, FIT_ROWS, 2)
    rows = texts.join(F.broadcast(sample), "doc_id")  # FIT_ROWS ids at most
    rows = rows.where((F.length("text") <= FIT_CHARS) | F.col("y").isin(long))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(FIT_ROWS).select("text", "y").toArrow()
    return got.column("text").to_pylist(), np.array(got.column("y").to_pylist(), dtype=np.int64), totals[1] / sum(totals)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    got = learnable(docs, labels, label)
    model = got and fit(*got)
    del got
    give_back()
    return model


def scores(texts: pa.Array, model: Model | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    w, b, orders = model
    doc, bucket = NGrams(texts, orders, BITS).distinct(w != 0)
    z = np.bincount(doc, weights=w[bucket].astype(np.float64), minlength=len(texts)) + b
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = scores(part.column("text"), model.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label))
    got = doc_rows(docs).mapInArrow(_scorer(model), "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(scores(part.column(text_col), model.value) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
