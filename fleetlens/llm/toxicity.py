"""Toxicity of whole texts: a linear classifier on character n-grams scaled by naive Bayes ratios.

Features are the hashed 4- to 8-grams inside the words of a text, each counted as present or not.
Their log-count ratios ``r = log((p / |p|) / (q / |q|))`` come from *all* labelled training texts
(``p``, ``q``: one plus the number of toxic and of other texts that hold the n-gram).  Features with a
clear ratio are kept, scaled by ``r``, and a logistic regression with L2 penalty is fitted on a sample
of at most ``sample`` labelled texts (those with the smallest hash of their id).  What reaches the
driver is bounded by the number of bins and by the sample, whatever the size of the corpus.

No labels, or labels of one class only: every text scores the smoothed share of toxic labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import whole_text
from fleetlens.llm.text import _LOWER, mix, pieces, word_hashes, word_spans
from fleetlens.plans.sizes import bounded

BINS = 1 << 18
CHUNK = 1 << 12
GRAMS = (4, 5, 6, 7, 8)
MIN_TEXTS = 3
MIN_RATIO = 1.0
SAMPLE = 6000
#: bytes of texts whose n-grams are held at once
PIECE_BYTES = 1 << 16
PENALTY = 1e-3
STEPS = 200


@dataclass(frozen=True)
class Model:
    """``weight[bin]`` is the classifier's weight times the ratio; absent bins are 0."""

    weight: np.ndarray
    bias: float


def _gram_bins(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, word) of every n-gram; ``words`` are bytes of words with an edge mark on both sides."""
    bins, owner = [], []
    value = words.astype(np.uint64) + np.uint64(1)
    which = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    with np.errstate(over="ignore"):
        rolling = value.copy()
        for n in range(2, max(GRAMS) + 1):
            if len(value) < n:
                break
            rolling = rolling[:-1] * np.uint64(0x100000001B3) + value[n - 1:]
            if n in GRAMS:
                inside = which[:len(rolling)] == which[n - 1:]
                bins.append(mix(rolling[inside] + np.uint64(n << 57)) & np.uint64(BINS - 1))
                owner.append(which[:len(rolling)][inside])
    if not bins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(bins).astype(np.int64), np.concatenate(owner)


def text_features(offsets: np.ndarray, data: np.ndarray, keep: np.ndarray | None = None):
    """Distinct (text, bin) pairs, sorted; ``keep`` limits them to some bins."""
    data = _LOWER[data]
    hashes, first_word = word_hashes(offsets, data, lower=False)
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none
    starts, ends = word_spans(offsets, data)
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = (ends - starts)[sample]
    spots = np.concatenate([[0], np.cumsum(size + 2)])
    spelt = np.zeros(spots[-1], np.uint8)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    spelt[np.repeat(spots[:-1] + 1, size) + place] = data[np.repeat(starts[sample], size) + place]
    spelt[spots[:-1]], spelt[spots[1:] - 1] = 2, 3
    bins, owner = _gram_bins(spelt, spots)
    if keep is not None:
        kept = keep[bins]
        bins, owner = bins[kept], owner[kept]
    order = np.argsort(owner, kind="stable")
    bins, owner = bins[order], owner[order]
    per_word = np.bincount(owner, minlength=len(sample))
    at = np.cumsum(per_word) - per_word
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first_word))
    pairs = np.unique(text * len(sample) + which)  # a word counts once in a text
    text, word = pairs // len(sample), pairs % len(sample)
    n = per_word[word]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    found = np.unique(np.repeat(text, n) * BINS + bins[np.repeat(at[word], n) + place])
    return found // BINS, found % BINS


def _class_counts(labelled: DataFrame) -> DataFrame:
    """Toxic and other texts per bin.  Each task sums its texts, then chunks of bins are added up."""

    def count(batches):
        sums = np.zeros((2, BINS), np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False)).astype(np.int64)
            for first, end, offsets, data in pieces(batch.column("_text"), PIECE_BYTES):
                text, bins = text_features(offsets, data)
                for label in (0, 1):
                    sums[label] += np.bincount(bins[toxic[first:end][text] == label], minlength=BINS)
        if sums.any():
            blocks = sums.reshape(2, -1, CHUNK)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(np.arange(BINS // CHUNK), pa.int32()),
                "sums": [blocks[:, i].tobytes() for i in range(BINS // CHUNK)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
                new = np.frombuffer(raw, np.int64).reshape(2, CHUNK)
                sums[chunk] = sums[chunk] + new if chunk in sums else new
        for chunk, both in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "sums": [both.tobytes()]})

    schema = "chunk int, sums binary"
    return (labelled.mapInArrow(count, schema)
            .repartition(BINS // CHUNK, "chunk").mapInArrow(add, schema))


def _features(labelled: DataFrame, keep: np.ndarray) -> DataFrame:
    def find(batches):
        for batch in batches:
            for first, end, offsets, data in pieces(batch.column("_text"), PIECE_BYTES):
                text, bins = text_features(offsets, data, keep)
                ends = np.searchsorted(text, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[first:end], "toxic": batch.column("toxic")[first:end],
                    "bins": pa.ListArray.from_arrays(pa.array(ends), pa.array(bins.astype(np.int32)))})

    kind = labelled.schema["doc_id"].dataType.simpleString()
    return labelled.mapInArrow(find, f"doc_id {kind}, toxic int, bins array<int>")


def fit_weights(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on present features scaled by ``scale``; full-batch adaptive gradients."""
    x, n = scale[cols], max(len(y), 1)
    w, b = np.zeros(len(scale)), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    seen, seen_b = np.full(len(scale), 1e-12), 1e-12
    for _ in range(STEPS):
        z = np.bincount(rows, x * w[cols], minlength=n) + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(cols, x * e[rows], minlength=len(scale)) / n + PENALTY * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
        seen_b += e.mean() ** 2
        b -= 0.3 * e.mean() / np.sqrt(seen_b)
    return w, b


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents.  Labels with a null are ignored; an id with two labels is toxic if
    one of them says so."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    labelled = docs.select("doc_id", whole_text(text).alias("_text")).join(bounded(known), "doc_id")
    counts = np.zeros((2, BINS))
    for row in _class_counts(labelled.select("_text", "toxic")).collect():  # BINS numbers twice
        counts[:, row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.sums, np.int64).reshape(2, CHUNK)
    n = dict(labelled.groupBy("toxic").count().collect())
    if not (n.get(0) and n.get(1)):
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 2)
        return Model(np.zeros(BINS), float(np.log(share / (1 - share))))
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    keep = (counts.sum(0) >= MIN_TEXTS) & (np.abs(ratio) >= MIN_RATIO)
    chosen = (known.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` rows
    some = _features(labelled.join(F.broadcast(chosen), "doc_id"), keep).toArrow().combine_chunks()
    slot, bins = np.cumsum(keep) - 1, some.column("bins").combine_chunks()
    rows = np.repeat(np.arange(some.num_rows), bins.value_lengths().to_numpy(zero_copy_only=False))
    cols = slot[bins.flatten().to_numpy(zero_copy_only=False)]
    w, b = fit_weights(some.column("toxic").to_numpy().astype(float), rows, cols, ratio[keep])
    weight = np.zeros(BINS)
    weight[keep] = w * ratio[keep]
    return Model(weight, b)


def score(text: Column, model: Model) -> Column:
    """Probability that a whole text is toxic; null and empty texts score the bias alone."""
    keep = model.weight != 0

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), model.bias)
        for first, end, offsets, data in pieces(texts, PIECE_BYTES):
            owner, bins = text_features(offsets, data, keep)
            out[first:end] += np.bincount(owner, model.weight[bins], minlength=end - first)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return scored(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Documents with a score below one half, with their own columns; repeated rows stay or go alike."""
    model = train(docs, labels, text)
    scored = docs.select(F.struct("*").alias("_row"), score(whole_text(text), model).alias("_score"))
    return scored.where("_score < 0.5").select("_row.*")
