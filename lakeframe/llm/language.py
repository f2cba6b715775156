"""Language identification as multilingual mixture inference.

Training counts, for every language of the labelled rows, the hashed byte trigrams of its words; Spark sums the counts
by language and bucket over all training text, and the smoothed log-probabilities (a table of fixed size for each
language) are broadcast.
A document is a mixture: each of its words comes from one language, with the likelihood that the language's trigrams
give it. Expectation-maximisation estimates the proportions; then nested sets of languages, by falling proportion, are
fitted anew and the set of the best penalised likelihood (BIC) is chosen. The predicted language has the greatest
proportion in that set, and its proportion is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_column, slices

BUCKET_BITS = 16
SMOOTHING = 0.5
ROUNDS = 8
REFITS = 4
#: A language beyond the first must explain this many times the usual BIC penalty.
PENALTY = 2.0
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, float32


def text_bytes() -> F.Column:
    """Lower-cased text in which everything but letters and marks is one space, with a space at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.coalesce(F.lower("text"), F.lit("")), r"[^\p{L}\p{M}]+", " "), F.lit(" ")).cast("binary")


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two."""
    code = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
    code = code * np.uint32(0x9E3779B1)
    return ((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            data, offsets = byte_column(batch.column("bytes"))
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                if lang in place and len(text) > 2:
                    counts[place[lang]] += np.bincount(trigram_buckets(text)[text[1:-1] != 32], minlength=1 << BUCKET_BITS)
        for i, lang in enumerate(languages):
            used = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[i][used])], names=["lang", "bucket", "n"])

    return run


def train_languages(documents: DataFrame) -> LanguageModel:
    """A model of the languages in the column lang; there are few of them, whatever the size of the table."""
    known = bounded(documents).where("lang is not null and text is not null")
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    counted = known.select("lang", text_bytes().alias("bytes")).mapInArrow(_count(languages), "lang string, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most all buckets of each language
    names = summed.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {x: i for i, x in enumerate(languages)}
    counts = np.full((len(languages), 1 << BUCKET_BITS), SMOOTHING)
    counts[[place[x] for x in names], summed.column("bucket").to_numpy()] += summed.column("n").to_numpy()
    return LanguageModel(languages, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)))


def word_likelihoods(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood of each word under each language (the greatest is 1), and each document's first word."""
    letters = data != 32
    starts = np.flatnonzero(letters & np.concatenate(([True], ~letters[:-1])))  # texts begin with a space
    if not len(starts):
        return np.zeros((0, len(model.languages)), np.float32), np.zeros(len(offsets), np.int64)
    scores = model.log_prob[trigram_buckets(data)]
    scores[~letters[1:-1]] = 0  # a trigram belongs to the word of its middle byte
    scores = np.add.reduceat(scores, starts - 1, axis=0)
    scores -= scores.max(axis=1, keepdims=True)
    return np.exp(scores), np.searchsorted(starts, offsets)


def _fit(likelihood: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of many documents at once: shares by document, and their log-likelihoods."""
    words = np.maximum(np.diff(np.append(first, len(doc))), 1)[:, None].astype(np.float32)
    for _ in range(rounds):
        joint = likelihood * share[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(joint, first, axis=0) / words
    mixed = np.log(np.maximum((likelihood * share[doc]).sum(axis=1), 1e-30))
    return share, np.add.reduceat(mixed.astype(np.float64), first)


def infer_mixtures(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Best language (-1 without letters) and its share, for each document in data."""
    n, k = len(offsets) - 1, len(model.languages)
    best, score = np.full(n, -1, np.int64), np.zeros(n)
    likelihood, first = word_likelihoods(data, offsets, model) if k and len(data) > 2 else (np.zeros((0, k)), np.zeros(n + 1, np.int64))
    has = np.flatnonzero(np.diff(first) > 0)
    if not len(has):
        return best, score
    words = np.diff(first)[has]
    starts = first[has]
    doc = np.repeat(np.arange(len(has)), words)
    share, _ = _fit(likelihood, doc, starts, np.full((len(has), k), 1 / k, np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    chosen, value = np.full(len(has), -np.inf), np.zeros((len(has), k), np.float32)
    for size in range(1, k + 1):
        inside = rank < size
        some = np.where(inside, np.maximum(share, 1e-6), 0).astype(np.float32)
        some /= some.sum(axis=1, keepdims=True)
        fitted, log_likelihood = _fit(likelihood, doc, starts, some, REFITS if size > 1 else 0)
        penalised = log_likelihood - PENALTY * 0.5 * (size - 1) * np.log(np.maximum(words, 2))
        better = penalised > chosen
        chosen[better], value[better] = penalised[better], fitted[better]
        if not better.any():
            break
    best[has] = value.argmax(axis=1)
    score[has] = value.max(axis=1)
    return best, np.clip(score, 0, 1)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = byte_column(batch.column("bytes"))
            best, score = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                best[i:j], score[i:j] = infer_mixtures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model)
            best[~batch.column("letters").to_numpy(zero_copy_only=False)] = -1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.where(best < 0, 0, score))], names=["doc_id", "lang_pred", "score"])

    return run


def held_out_fold(folds: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def identify_languages(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Rows with crc32(doc_id) mod 3 = 1 are held out from training.

    Null texts and texts without a letter are "und" with score 0, as are all if nothing can be learned from. A null
    doc_id is neither held out nor learned from. Repeated rows count as often as they occur. Equal shares go to the
    first language by name; other columns are not read.
    """
    model = train_languages(documents.where(held_out_fold(3) != 1).select("lang", "text"))
    rows = bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
