"""Importance resampling towards a target distribution, in two Arrow passes.

Features are runs of words, hashed into ``BUCKETS`` buckets. The first pass counts them: every task sums its texts with
``np.bincount`` into one vector of ``BUCKETS`` counts (80 kB), and ``treeReduce`` adds the vectors, so the driver gets one.
The vectors of source and target give every bucket a gain, its smoothed log ratio in thousandths. The gains are broadcast
(80 kB whatever the input), and the second pass gathers them for all features of a batch and sums them by document with
``np.bincount`` weights (integers below 2**53, so the sums are exact). A document's weight is its mean gain; Gumbel noise
from a hash of its id makes the highest scores a sample without replacement.

The draw needs no global sort: the histogram of the integer scores (some 10**5 values at most: gains of 64-bit counts stay
within +-44,000 and the noise between -3,200 and 23,000) says from which score on rows can be drawn, and only these are
numbered by ranges of (score, doc_id). Rows that stand there many times are spread over ranges by their place.

Edge cases: null, empty and wordless texts have no features and weight 0; a null doc_id draws as the empty id, behind
equal scores; rows repeated under one id share the noise and are drawn one by one; an empty table gives an empty result,
and with an empty target gains follow from T = 0.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.common import assign_ids

from .common import CACHE_WORDS, checkpoint, fields_for, utf8

#: Buckets of features, their longest run of words, percent of the documents to draw and the words that they need.
BUCKETS, NGRAMS, SHARE, MIN_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Features that are counted at once.
_AT_ONCE = 200_000

#: Words are runs of digits, letters a-z (A-Z are lower-cased) and all that is not ASCII; other bytes part them.
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def features(text: str | None, ngrams: int = NGRAMS) -> list[bytes]:
    """All runs of 1 to ``ngrams`` words, joined by one space."""
    words = utf8(text).translate(_TO_WORDS).split()
    out = words
    for n in range(2, ngrams + 1):
        out = out + list(map(b" ".join, zip(*[words[j:] for j in range(n)], strict=False)))
    return out


class _Buckets(dict):
    """feature -> bucket; short features are kept up to a bound."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        value = zlib.crc32(feature) % self.buckets
        if len(self) < CACHE_WORDS and len(feature) <= 64:
            self[feature] = value
        return value


def _bucketed(texts: pa.Array, buckets: _Buckets, ngrams: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, features of each text, buckets of all of them), a few texts at once."""
    first, sizes, ids = 0, [], []
    for k, text in enumerate(texts):
        found = features(text.as_py(), ngrams)
        sizes.append(len(found))
        ids.append(np.fromiter(map(buckets.__getitem__, found), np.int32, len(found)))
        if sum(map(len, ids)) >= _AT_ONCE or k == len(texts) - 1:
            yield first, np.array(sizes), np.concatenate(ids)
            first, sizes, ids = k + 1, [], []


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> np.ndarray:
    """Counts of the features of all rows of ``texts`` (text) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, ids in _bucketed(b.column(0), known, ngrams):
                total += np.bincount(ids, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = fields_for(texts, "text").mapInArrow(run, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of target to source by bucket, in thousandths, rounded down."""
    n, big_s, big_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + n) / ((s + 1) * (big_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, ngrams: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every row."""
    told = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, known = told.value, _Buckets(len(told.value))
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, sizes, found in _bucketed(b.column(1), known, ngrams):
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=gain[found], minlength=len(sizes)).astype(np.int64)
                weight = sums // np.maximum(sizes, 1)
                names = ids[first : first + len(sizes)]
                score = weight + np.array([_noise(x, seed) for x in names], np.int64)
                # of w words there are w + (w - 1) + ... runs
                words = sizes if ngrams == 1 else np.array([next(w for w in range(n + 1) if sum(max(w - j, 0) for j in range(ngrams)) >= n) for n in sizes.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.int64()), pa.array(weight), pa.array(score)], ["doc_id", "n_features", "n_words", "weight", "score"])

    return fields_for(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


def importance_resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, buckets: int = BUCKETS, ngrams: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs`` (doc_id, text): rank 1, 2, 3... of the ``share``
    percent of the documents of at least ``min_words`` words that are drawn for the distribution of ``target`` (text), null
    for all others."""
    gain = gains(bucket_counts(docs, buckets, ngrams), bucket_counts(target, buckets, ngrams))
    rows = checkpoint(scored(docs, gain, ngrams, seed))
    takes_part = F.col("n_words") >= min_words
    histogram = sorted(((r["score"], r["count"]) for r in rows.where(takes_part).groupBy("score").count().collect()), reverse=True)
    drawn, met, least = share * sum(n for _, n in histogram) // 100, 0, None
    for score, n in histogram:
        if met >= drawn:
            break
        met, least = met + n, score
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = takes_part & (F.col("score") >= least)
    ordered = rows.where(high).select(*columns, (-F.col("score")).alias("__low"), F.col("doc_id").isNull().alias("__none"), F.monotonically_increasing_id().alias("__at"))
    ranked = assign_ids(ordered, ["__low", "__none", "doc_id", "weight", "n_features", "__at"], "rank", 1)
    return ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rows.where(~high).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is drawn."""
    ids = checkpoint(importance_resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct())
    return docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__drawn")), "left_semi")
