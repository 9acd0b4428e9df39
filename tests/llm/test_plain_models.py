"""Importance resampling and the toxicity classifier against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.llm import importance, toxicity
from fleetlens.llm.text import pieces, word_hashes

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MASK = (1 << 64) - 1


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def hash_of(word):
    """The library's name of a word, from a text of that word alone."""
    return next(int(word_hashes(o, d)[0][0]) for _, _, o, d in pieces(pa.array([word])))


# importance

def buckets_of(text, names):
    words = [names.setdefault(w, hash_of(w)) for w in words_of(text)]
    pairs = []
    for pair in zip(words, words[1:]):
        value = 2
        for w in pair:
            value = plain_mix((value * 0x9FB21C651E98DF25 + w) & MASK)
        pairs.append(value)
    return [x % importance.BUCKETS for x in words + pairs]


def test_importance_equals_plain_python(spark):
    rng, names = np.random.default_rng(7), {}
    vocabulary = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[:30] if i % 3 else vocabulary, rng.integers(0, 25)))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, "x"), rows[4]]
    labels = [(i, int(i % 3 != 0)) for i in range(60)] + [(4, 0), (7, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = importance.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), share=0.4).collect()
    good = {i for i, q in labels if q == 1} - {i for i, q in labels if q == 0} - {None}
    raw, target = Counter(), Counter()
    for i, text in rows:
        found = buckets_of(text, names)
        raw.update(found)
        target.update(found if i in good else [])
    n = importance.BUCKETS
    total = (sum(target.values()) + n, sum(raw.values()) + n)

    def ratio(b):
        return math.log((target[b] + 1) / total[0]) - math.log((raw[b] + 1) / total[1])
    want = {i: sum(ratio(b) for b in buckets_of(text, names)) for i, text in rows}
    noise = {r.doc_id: r.g for r in docs.select("doc_id", importance.gumbel(11).alias("g")).collect()}
    for r in got:
        assert r.is_target == (r.doc_id in good)
        assert math.isclose(r.log_importance, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.gumbel_key, want[r.doc_id] + noise[r.doc_id], rel_tol=1e-9, abs_tol=1e-9)
    k = math.ceil(0.4 * len(rows))
    cut = sorted((want[i] + noise[i] for i, _ in rows), reverse=True)[k - 1]
    assert {r.doc_id for r in got if r.kept} == {i for i in want if want[i] + noise[i] >= cut - 1e-6}


# toxicity

def grams_of(text):
    """Bins of the 4- to 8-grams of every word between two marks."""
    out = set()
    for word in set(words_of(text)):
        spelt = bytes([2]) + word.encode() + bytes([3])
        for n in toxicity.GRAMS:
            for i in range(len(spelt) - n + 1):
                value = 0
                for byte in spelt[i:i + n]:
                    value = (value * 0x100000001B3 + byte + 1) & MASK
                out.add(plain_mix((value + (n << 57)) & MASK) & (toxicity.BINS - 1))
    return out


def plain_fit(y, features, scale):
    """The same descent, a text and a feature at a time."""
    n, w, seen = len(y), dict.fromkeys(scale, 0.0), dict.fromkeys(scale, 1e-12)
    b, seen_b = math.log((sum(y) + 0.5) / (n - sum(y) + 0.5)), 1e-12
    for _ in range(toxicity.STEPS):
        error = [1 / (1 + math.exp(-(b + sum(scale[f] * w[f] for f in fs)))) - t for t, fs in zip(y, features)]
        for f in scale:
            g = sum(e * scale[f] for e, fs in zip(error, features) if f in fs) / n + toxicity.PENALTY * w[f]
            seen[f] += g * g
            w[f] -= 0.3 * g / math.sqrt(seen[f])
        mean = sum(error) / n
        seen_b += mean ** 2
        b -= 0.3 * mean / math.sqrt(seen_b)
    return w, b


def test_toxicity_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["plain", "weather", "Ähre", "nothing", "sunny", "of", "walk", "x"]
    rows = [(i, " ".join(rng.choice(vocabulary, 6)) + (" Wretchling fool" if i % 4 == 0 else "")) for i in range(40)]
    rows += [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).where("doc_id < 36 OR doc_id > 40")
    model = toxicity.train(docs, labels)
    known = [(text, int(i % 4 == 0)) for i, text in rows if i < 36 or i > 40]
    found = [grams_of(text) for text, _ in known]
    counts = [Counter(), Counter()]
    for (_, toxic), grams in zip(known, found):
        counts[toxic].update(grams)
    total = [sum(c.values()) + toxicity.BINS for c in counts]
    ratio = {g: math.log(((counts[1][g] + 1) / total[1]) / ((counts[0][g] + 1) / total[0])) for g in counts[0] + counts[1]}
    scale = {g: r for g, r in ratio.items() if counts[0][g] + counts[1][g] >= toxicity.MIN_TEXTS and abs(r) >= toxicity.MIN_RATIO}
    assert scale
    w, b = plain_fit([t for _, t in known], [f & set(scale) for f in found], scale)
    assert math.isclose(model.bias, b, rel_tol=1e-6)
    assert set(np.flatnonzero(model.weight)) <= set(scale)
    assert all(math.isclose(model.weight[g], w[g] * scale[g], rel_tol=1e-6, abs_tol=1e-9) for g in scale)
    scored = docs.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("s")).collect()
    for r in scored:
        z = b + sum(w[g] * scale[g] for g in grams_of(r.text) & set(scale))
        assert math.isclose(r.s, 1 / (1 + math.exp(-z)), rel_tol=1e-6)
