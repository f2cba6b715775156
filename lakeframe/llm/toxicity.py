"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

1. Over all labelled training rows, count in how many toxic and other documents each hashed n-gram occurs; each task
   gives a row for each bucket it met, which Spark sums.
2. The log ratio of both rates scales a feature. FEATURES buckets are kept, those whose rates differ most surely.
3. A logistic regression of the scaled presences is fitted on at most SAMPLE rows of each class, those whose ids have
   the least hash, weighted by how many of their class there are. This is the one bounded sample; it is chosen from the
   labels alone, so only these few texts are read for it.
4. All documents are scored, whole, by looking up each position's buckets in the broadcast table of weights, whose
   size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, byte_column, slices

ORDERS = (4, 5, 6)
BUCKET_BITS = 18
FEATURES = 2048
SAMPLE = 3000
SMOOTHING = 1.0
PENALTY = 0.02
#: Label rows up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class ToxicityModel:
    bucket_slot: np.ndarray  # feature of each bucket, or -1
    weights: np.ndarray  # by feature, its log-count ratio included
    ratios: np.ndarray  # log-count ratio by feature
    bias: float


def text_bytes() -> F.Column:
    """Lower-cased text between two spaces, so that n-grams know where words begin and end."""
    return F.concat(F.lit(" "), F.coalesce(F.lower("text"), F.lit("")), F.lit(" ")).cast("binary")


def gram_buckets(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; 0, a bucket that is never used, where it leaves its document."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for i in range(order):
        code |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    code = (code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((code ^ (code >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    for back in range(1, order):  # a document has a space at both ends, so the last order - 1 bytes start no n-gram
        at = offsets[1:] - back
        bucket[at[(at >= 0) & (at < n)]] = 0
    return bucket


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.uint32)
    docs = np.zeros(2, np.int64)
    present = np.zeros(1 << BUCKET_BITS, bool)
    for batch in batches:
        data, offsets = byte_column(batch.column("bytes"))
        toxic = batch.column("toxic").to_numpy()
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            present[:] = False
            for order in ORDERS:
                present[gram_buckets(text, np.array([0, len(text)]), order)] = True
            counts[toxic[i]] += present
            docs[toxic[i]] += 1
    if docs.sum():
        counts[:, 0] = docs  # bucket 0 is that of no n-gram
        met = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(c[met].astype(np.int64)) for c in counts)], names=["bucket", "n0", "n1"])


def active_features(data: np.ndarray, offsets: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the documents in data; there is at most a feature a bucket."""
    found = []
    for order in ORDERS:
        features = slot[gram_buckets(data, offsets, order)]
        at = np.flatnonzero(features >= 0)
        found.append(np.searchsorted(offsets, at, side="right") - 1 << BUCKET_BITS | features[at])
    pairs = np.unique(np.concatenate(found))
    return pairs >> BUCKET_BITS, pairs & (1 << BUCKET_BITS) - 1


def _features(slot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("bytes"))
            row, feature = active_features(data, offsets, slot)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            rows = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("nth"), batch.column("toxic"), pa.array(rows, pa.binary())], names=["nth", "toxic", "features"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the penalised, weighted log loss."""
    n, m = x.shape
    weight = weight / weight.sum()
    v = np.ones(m, np.float32)  # the greatest eigenvalue bounds the step
    for _ in range(20):
        v = x.T @ (weight * (x @ v)).astype(np.float32)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    bound = 0.25 * (float(np.sum(weight * (x @ v) ** 2)) + 1) * 1.2 + penalty
    w, b = np.zeros(m, np.float32), 0.0
    w_ahead, b_ahead, momentum = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w_ahead + b_ahead, -30, 30)))
        error = (weight * (p - y)).astype(np.float32)
        w_next = w_ahead - (x.T @ error + penalty * w_ahead) / bound
        b_next = b_ahead - float(error.sum()) / bound
        ahead = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        w_ahead = w_next + (momentum - 1) / ahead * (w_next - w)
        b_ahead = b_next + (momentum - 1) / ahead * (b_next - b)
        w, b, momentum = w_next, b_next, ahead
    return w, b


def labelled_sample(known: DataFrame, size: int) -> DataFrame:
    """(doc_id, toxic, nth): the ids of each class with the least hashes, at most size of them, in that order."""
    few = None
    for label in (0, 1):
        one = known.where(F.col("toxic") == label).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(size)
        few = one if few is None else few.unionByName(one)
    return few.select("doc_id", "toxic", F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id")).alias("nth"))


def train_toxicity(documents: DataFrame, labels: DataFrame, features: int = FEATURES, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on the rows of labels with toxic 0 or 1, whatever they are; the caller keeps held-out rows back."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = bounded(documents).select("doc_id", "text")
    joined = texts.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "doc_id")
    counted = joined.select("toxic", text_bytes().alias("bytes")).mapInArrow(_count, "bucket int, n0 long, n1 long")
    summed = counted.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most all buckets
    counts = np.zeros((2, 1 << BUCKET_BITS))
    at = summed.column("bucket").to_numpy()
    counts[0, at], counts[1, at] = summed.column("n0").to_numpy(), summed.column("n1").to_numpy()
    n0, n1 = counts[:, 0].tolist()
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    if not n0 or not n1:
        none = np.zeros(features, np.float32)
        return ToxicityModel(slot, none, none, float(np.log((n1 + 0.5) / (n0 + 0.5))))
    kept, scale = choose_features(counts, n0, n1, features)
    slot[kept] = np.arange(len(kept))
    few = texts.join(F.broadcast(labelled_sample(known, sample)), "doc_id").select("nth", "toxic", text_bytes().alias("bytes"))  # 2 * sample rows
    found = few.mapInArrow(_features(slot), "nth int, toxic int, features binary").orderBy("nth", "toxic", "features").limit(2 * sample).collect()
    x = np.zeros((len(found), len(kept)), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r.features, np.int32)] = 1
    x *= scale
    y = np.array([r.toxic for r in found], np.float32)
    weight = np.where(y == 1, n1 / max(1, y.sum()), n0 / max(1, len(y) - y.sum()))
    w, b = fit_logistic(x, y, weight, PENALTY)
    weights, ratios = np.zeros(features, np.float32), np.zeros(features, np.float32)
    weights[: len(kept)], ratios[: len(kept)] = w * scale, scale
    return ToxicityModel(slot, weights, ratios, b)


def choose_features(counts: np.ndarray, n0: float, n1: float, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose rates in both classes differ most surely, and their log-count ratios."""
    sizes = np.array([[n0], [n1]])
    rate = (counts + SMOOTHING) / (sizes + 2 * SMOOTHING)
    ratio = np.log(rate[1] / rate[0])
    sure = np.abs(rate[1] - rate[0]) / np.sqrt((rate * (1 - rate) / sizes).sum(axis=0) + 1e-12)
    sure[counts.sum(axis=0) == 0] = 0
    sure[0] = 0
    kept = np.argsort(-sure, kind="stable")[:features]
    kept = kept[sure[kept] > 0]
    return kept, ratio[kept].astype(np.float32)


def _score(model: ToxicityModel, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("bytes"))
            total = np.full(batch.num_rows, model.bias, np.float64)
            for i, j in slices(offsets):
                row, feature = active_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.bucket_slot)
                total[i:j] += np.bincount(row, weights=model.weights[feature], minlength=j - i)
            score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score)], names=[*columns, "score"])

    return run


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, text and score of every row; null and empty texts get the score of no feature at all."""
    rows = bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    return rows.mapInArrow(_score(model, ["doc_id"]), "doc_id long, score double")


def held_out_fold(folds: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Labels of the held-out fifth are not learned from.

    Repeated and contradicting labels of a document count once, as toxic if any is; null labels and ids teach
    nothing; without labels of both classes every score is the smoothed share of toxic rows; a null doc_id is scored
    and not held out; empty tables give no rows. Other columns are not read.
    """
    model = train_toxicity(documents, labels.select("doc_id", "toxic").where(held_out_fold(5) != 0))
    return score_toxicity(documents, model).select(
        "doc_id", F.coalesce(held_out_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without the rows that the classifier calls toxic; all columns stay as they are."""
    model = train_toxicity(documents, labels.select("doc_id", "toxic").where(held_out_fold(5) != 0))
    rows = bounded(documents).select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), text_bytes().alias("bytes"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    kept = rows.mapInArrow(_score(model, ["row"]), schema).where("score < 0.5")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
