"""Quality selection by importance resampling over hashed n-gram models, sampled by Gumbel top-k.

Two generative bag-of-n-gram models over hashed buckets are estimated: one of the target text, the labelled
documents of good quality, one of the raw text, which is every document. A document's log importance weight is the
log ratio of the two over all its n-grams (words and single marks, and pairs of them). Adding independent Gumbel noise and taking
the k largest draws k documents without replacement in proportion to their weights.

The target model is fitted on at most ``max_labelled`` labelled documents, those of smallest hash; everything
else covers all documents. Counts are summed inside tasks, so that at most two rows a bucket leave each. The k-th largest key is
found exactly by its bits, 16 at a time, from counts by bits; no document is collected.

Defined cases: a null text is an empty text, which has log weight 0; a very long text is weighed whole; documents whose key equals the k-th
largest all stay; labels without a document, or null labels, count for nothing; without a target document all
log weights are 0; an empty table gives an empty result; rows repeated are weighed alike and share their noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordarrays as W
from .common import cut, small_batches


def buckets_of(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the texts, and the number of the text it is in."""
    data, offsets = W.lay_out(texts)
    starts, ends = W.spans(data, W.punct_table())
    h, owner = W.hashes(data, starts, ends), W.owners(starts, offsets)
    same = owner[1:] == owner[:-1]
    pairs = W.mix(h[:-1] * np.uint64(3) + W.mix(h[1:]))[same] if len(h) else h
    return (np.concatenate((h, pairs)) % np.uint64(buckets)).astype(np.int64), np.concatenate((owner, owner[1:][same]))


def fit(docs: DataFrame, targets: DataFrame, buckets: int, text: str, doc_id: str) -> np.ndarray:
    """log p(target) - log p(raw) by bucket. ``targets`` (id): the ids of the target documents, of checked number."""
    small_batches(docs.sparkSession)
    marked = targets.select(F.col("id").alias("__id"), F.lit(True).alias("__good"))
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(marked), F.col("__doc") == F.col("__id"), "left").select("text", F.coalesce("__good", F.lit(False)).alias("good"))

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in it:
            b, owner = buckets_of(batch.column(0).to_pylist(), buckets)
            good = batch.column(1).to_numpy(zero_copy_only=False)
            total[0] += np.bincount(b, minlength=buckets)
            total[1] += np.bincount(b[good[owner]], minlength=buckets)
        model, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[model, bucket])], names=["model", "bucket", "n"])

    counts = np.zeros((2, buckets), np.float64)
    for model, bucket, n in rows.mapInArrow(sums, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[model, bucket] = n
    if not counts[1].sum():
        return np.zeros(buckets)
    smoothed = np.log(counts + 1) - np.log((counts + 1).sum(axis=1, keepdims=True))
    return smoothed[1] - smoothed[0]


def weigh(docs: DataFrame, log_ratio: np.ndarray, seed: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, log_weight, key (the log weight with the document's Gumbel noise), order (key's bits as a long of the same order)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("noise"), F.col(text).cast("string").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            b, owner = buckets_of(batch.column(2).to_pylist(), len(log_ratio))
            weight = np.bincount(owner, log_ratio[b], minlength=batch.num_rows)
            u = (W.mix(batch.column(1).to_numpy().view(np.uint64)).astype(np.float64) + 0.5) / 2.0**64
            u = np.clip(u, 1e-300, 1 - 2.0**-53)
            key = weight - np.log(-np.log(u)) + 0.0
            bits = key.view(np.int64)
            order = bits ^ (bits >> 63 & np.int64(2**63 - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key), pa.array(order)], names=["doc_id", "log_weight", "key", "order"])

    return rows.mapInArrow(batches, "doc_id long, log_weight double, key double, order long")


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a column of longs without nulls, exactly; None if k is below 1 or above their number.

    Four passes count the rows by 16 bits each, of those that agree with the answer's bits so far; at most 65,536 counts
    come to the driver a pass.
    """
    if k < 1:
        return None
    rows, value = keys.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("v")), 0  # unsigned order
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF))
        for d, n in sorted(((r["d"], r["count"]) for r in rows.groupBy(digit.alias("d")).count().collect()), reverse=True):
            if k <= n:
                break
            k -= n
        else:
            return None
        rows, value = rows.where(digit == d), value << 16 | d
    return value - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = 10_000, max_labelled: int = 100_000, seed: int = 5, text: str = "text", doc_id: str = "doc_id", good: Column | None = None) -> DataFrame:
    """One row per document: doc_id, log_weight, key, kept.

    ``share`` of the documents is kept; None takes the share of quality 1 among the labelled. ``labels`` has
    ``doc_id``, and ``quality`` and ``toxic`` unless ``good`` tells the targets (else: quality 1 and not toxic).
    """
    if share is None:
        labelled, fine = labels.agg(F.count("quality"), F.count(F.when(F.col("quality") == 1, 1))).first()
        share = fine / labelled if labelled else 1.0
    if good is None:
        good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    ids = labels.where(good & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id")).distinct()
    targets = ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_labelled)
    ratio = fit(docs, targets, buckets, text, doc_id)
    weighed = cut(weigh(docs, ratio, seed, text, doc_id))
    at = kth_largest(weighed, "order", round(share * weighed.count()))
    return weighed.select("doc_id", "log_weight", "key", (F.col("order") >= F.lit(at) if at is not None else F.lit(False)).alias("kept"))
