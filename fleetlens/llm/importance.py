"""Importance resampling of texts towards a target (Xie et al., 2023).

Target and raw texts each get a generative model over hashed 1- and 2-grams of words: a multinomial
over ``BUCKETS`` buckets with add-one smoothing.  A text's importance is the log-ratio of its
probability under the two models; adding Gumbel noise and taking the ``k`` largest samples ``k`` texts
without replacement in proportion to it.  The noise is a hash of the id, so a rerun samples the same.

Models are sums over all texts with a row per bucket and task in the shuffle; the driver sees BUCKETS
numbers.  The k-th largest key is found exactly by counting keys in ever finer ranges, 2**16 at a time, so
nothing is sorted or gathered.  Texts whose key equals the k-th are all selected (ties stay together).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import whole_text, written
from fleetlens.llm.text import pieces, windows, word_hashes
from fleetlens.plans.sizes import bounded

BUCKETS = 10_000
SHARE = 0.8
_DIGIT = 16


def text_buckets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every 1- and 2-gram of the words, in lower case."""
    words, first_word = word_hashes(offsets, data)
    pairs, first_pair = windows(words, first_word, 2)
    texts = np.arange(len(offsets) - 1)
    owner = np.concatenate([np.repeat(texts, np.diff(first_word)), np.repeat(texts, np.diff(first_pair))])
    return owner, (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``bucket, target, raw`` sums over all rows of ``docs (is_target, _text)``."""

    def count(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            for first, end, offsets, data in pieces(batch.column("_text")):
                owner, bucket = text_buckets(offsets, data)
                sums[1] += np.bincount(bucket, minlength=BUCKETS)
                sums[0] += np.bincount(bucket[target[first:end][owner]], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(BUCKETS), pa.int32()),
                                          "target": sums[0], "raw": sums[1]})

    return (docs.mapInArrow(count, "bucket int, target long, raw long")
            .groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")))


def log_ratios(docs: DataFrame) -> np.ndarray:
    """One number per bucket; without target texts every ratio is 0, since nothing is known."""
    counts = np.ones((2, BUCKETS))
    for row in bucket_counts(docs).collect():
        counts[:, row.bucket] += (row.target, row.raw)
    if counts[0].sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def log_importance(text: Column, ratios: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def weighed(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for first, end, offsets, data in pieces(texts):
            owner, bucket = text_buckets(offsets, data)
            out[first:end] = np.bincount(owner, ratios[bucket], minlength=end - first)
        return pa.array(out)

    return weighed(text)


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id; a null id has one fixed value."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) * 2.0 ** -53
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs in ``key``, by counting: 16 bits of it in each pass."""
    known, left = F.lit(True), k
    value = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift) if shift == 48 else F.shiftright("key", shift).bitwiseAND(0xFFFF)
        counts = keys.where(known).groupBy(digit.alias("d")).count().orderBy(F.desc("d")).collect()  # 2**16 at most
        for d, n in counts:
            if left <= n:
                value = (value << _DIGIT) + d
                known = F.shiftright("key", shift) == F.lit(value)
                break
            left -= n
        else:
            return None
    return value


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 11,
             text: str = "text") -> DataFrame:
    """``doc_id, is_target, log_importance, gumbel_key, kept``: a row per document, ``kept`` for the
    ``ceil(share * n)`` sampled (and ties with the last).

    Target texts are those labelled ``quality = 1`` by every label of their id; labels with a null take
    no part.  Null and empty texts have no n-grams and importance 0.  Repeated rows have equal keys.
    """
    good = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id", F.lit(True).alias("is_target")))
    marked = (docs.select("doc_id", whole_text(text).alias("_text")).join(bounded(good), "doc_id", "left")
              .withColumn("is_target", F.coalesce("is_target", F.lit(False))))
    ratios = log_ratios(marked)
    scored = written(marked.select("doc_id", "is_target", log_importance(F.col("_text"), ratios).alias("log_importance"))
                     .withColumn("gumbel_key", F.col("log_importance") + gumbel(seed)), "importance")
    # an order-preserving integer: keys in steps of 2**-20, beyond any rounding of the sums
    step = F.round(F.col("gumbel_key") * 2.0 ** 20).cast("long")
    n = scored.count()
    cut = kth_largest(scored.select(step.alias("key")), -(-int(n * share * 1000) // 1000)) if n else None
    return scored.withColumn("kept", step >= F.lit(cut if cut is not None else 0))
