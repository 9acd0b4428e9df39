"""Centroid clustering, ranked search and language identification against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import clusters, language, lexical
from fleetlens.llm.common import fold, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# clustering

def brute_clusters(rows, k=8, rounds=10, seed=3):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        said = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), s in zip(kept, said) if s == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    said = [nearest(v) for _, v in kept]
    inertia = Counter()
    for d, n in said:
        inertia[n] += d
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()),
                   hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                  for (i, _), (d, n) in zip(kept, said))


def got_clusters(df, **more):
    return sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in clusters.cluster(df, **more).collect())


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(
        rng.normal(size=(6, 64))[rng.integers(6, size=90)] + 0.3 * rng.normal(size=(90, 64)))]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [rows[7], rows[7]]  # copies, repeated rows
    rows += [(300, None), (301, [1.0] * 63), (302, [None] + [1.0] * 63), (303, [float("nan")] * 64),
             (304, [float("inf")] * 64), (305, [0.0] * 64), (None, rows[3][1]), (306, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id long, embedding array<float>, cluster string, v int").repartition(3)
    want = brute_clusters(rows)
    assert got_clusters(df) == want and len(want) == 90 + 40 + 2 + 2
    assert got_clusters(df, pivots=1) == want
    few = rows[:3]
    assert got_clusters(spark.createDataFrame(few, "vec_id long, embedding array<float>")) == brute_clusters(few)
    assert got_clusters(df.limit(0)) == got_clusters(df.where("vec_id IN (300, 301)")) == []


def test_clusters_of_equal_and_collinear_vectors(spark):
    """No pivot stands clear of the others, centroids coincide, and one cluster holds almost all rows."""
    rows = [(i, [1.0] * 64) for i in range(50)] + [(50 + i, [float(i)] * 64) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got_clusters(df) == brute_clusters(rows)


def test_bounds_never_lose_the_nearest_centroid():
    rng = np.random.default_rng(3)
    for scale in (1, 1000, 1 << 27):
        for dims in (2, 64):
            x = rng.integers(-scale, scale + 1, (300, dims))
            x[rng.integers(300, size=60)] = x[0]
            base, centroids = clusters.simplex(x[:40]), x[rng.integers(300, size=8)]
            distance = np.stack([((x - c).astype(object) ** 2).sum(1) for c in centroids], 1)
            near = clusters.candidates_of(base.project(x), base.project(centroids))
            assert (near | (distance > distance.min(1, keepdims=True))).all()
            number, best = clusters.assign(x, base.project(x), centroids, base)
            assert (best == distance.min(1)).all() and (number == distance.argmin(1)).all()
    spread = rng.normal(0, 3000, (8, 64))[rng.integers(8, size=500)] + rng.normal(0, 300, (500, 64))
    x = np.floor(spread).astype(np.int64)
    base = clusters.simplex(x[:64])
    assert clusters.candidates_of(base.project(x), base.project(x[:8])).mean() < 0.9  # it filters


# ranked search

def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for (i, c), size in zip(held, sizes):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // total))) for t in terms if c[t])
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got_search(docs, items, **more):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked(docs, items, **more).collect()), key=str)


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    chance = 1 / np.arange(1, 401)
    texts = [(i, " ".join(rng.choice(words, rng.integers(1, 200), p=chance / chance.sum()))) for i in range(150)]
    texts += [(200 + i, texts[4][1]) for i in range(60)]  # copies, many of which tie
    texts += [texts[8]] * 3 + [(300, None), (301, ""), (302, " \n.,!"), (None, texts[4][1]), (None, "w3 w9 w9"),
                               (303, "Über-Straße w17 É é 漢字\x85w17"), (304, "W17 W17, w17! " * 40 + "rareterm"),
                               (305, " ".join(f"v{i} v{i}" for i in range(30_000)) + " rareterm")]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(12)]
    items += [(20, texts[4][1]), (21, None), (22, ""), (23, "no such thing"), (24, "RARETERM über straße 漢字\x85w17"),
              (25, "w1"), (25, "w2 w1"), (None, "w5 w6"), (26, "v7 v29999 w399")]
    return texts, items


@pytest.mark.parametrize("k, pack_bytes", [(10, 1 << 20), (3, 200)])
def test_search_equals_brute_force(spark, library, k, pack_bytes):
    texts, items = library
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], "doc_id long, text string, score int, digest string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = got_search(docs.repartition(4), asked, k=k, pack_bytes=pack_bytes)
    assert got == brute_search(texts, items, k)


def test_search_in_empty_tables(spark, library):
    texts, items = library
    docs = spark.createDataFrame(texts[:3], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert got_search(docs.limit(0), asked) == got_search(docs, asked.limit(0)) == got_search(blank, asked) == []
    assert got_search(docs, asked) == brute_search(texts[:3], items)


def test_bounds_are_upper_bounds(library):
    texts, items = library
    kind = pa.int64()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), kind), "_text": [t or "" for _, t in texts],
                                        "digest": [i.to_bytes(16, "big") for i in range(len(texts))]})
    blocks = list(lexical._blocks(iter([batch]), kind))
    hashes = {i: np.concatenate([lexical.term_hashes(o, d)[0] for _, _, o, d in lexical.pieces(pa.array([t or ""]))])
              for i, (_, t) in enumerate(texts)}
    asked = [np.unique(np.concatenate([lexical.term_hashes(o, d)[0] for _, _, o, d in lexical.pieces(pa.array([t]))]))
             for _, t in items if t]
    terms = np.unique(np.concatenate(asked))
    held = [h for h in hashes.values() if len(h)]
    pack = lexical.Pack(terms, [np.searchsorted(terms, a) for a in asked], len(held), sum(map(len, held)))
    df = sum(pack.count(*(np.frombuffer(b.column(c)[0].as_buffer(), t) for c, t in (("terms", "<u8"), ("holders", "<i8"))))
             for b in blocks)
    assert df.tolist() == [sum(t in h for h in held) for t in terms]
    pack.weights = np.where(df > 0, 500, 0)
    tight = total = 0
    for bits, sizes, tops, slices, digests, _ in lexical._parts(iter(blocks)):
        bound = pack.bounds(bits, sizes, tops, slices)
        exact = np.array([pack.score(hashes[int.from_bytes(d, "big")], list(range(len(asked)))) for d in digests]).T
        assert (bound >= exact).all()
        tight, total = tight + (bound <= 1.2 * exact + 1).sum(), total + bound.size
    assert tight > 0.8 * total


# language

def sums_over_segmentations(vocab, word, chances):
    """Log of the sum over all segmentations, by the definition."""
    number = {p: i for i, p in enumerate(vocab.pieces)}
    best = [np.zeros(chances.shape[1])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        terms = [best[s] + np.log(chances[number[word[s:end]]]) for s in range(max(0, end - language.PIECE_BYTES), end)
                 if word[s:end] in number]
        best[end] = np.logaddexp.reduce(terms)
    return best[-1]


def every_segmentation(vocab, word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in vocab:
            yield from ([word[:n], *rest] for rest in every_segmentation(vocab, word[n:]))


def test_forward_sums_all_segmentations():
    vocab, rng = language.vocabulary(PIECES), np.random.default_rng(1)
    chances = rng.random((len(vocab.pieces), 3)) / len(vocab.pieces)
    words = ["the", "strasse", "nationalité", "漢字", "a", "xqzj" * 60, "ththe" * 90]
    words.sort(key=lambda w: -len(w.encode()))
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    flat, begin, size = language.spell(data, ends - [len(w.encode()) for w in words], ends)
    got = language.forward(vocab, flat, begin, size, chances)
    for g, w in zip(got, words):
        assert np.allclose(g, sums_over_segmentations(vocab, b" " + w.encode(), chances), rtol=1e-9)
    number = {p: i for i, p in enumerate(vocab.pieces)}
    for w in ("the", "strasse"):
        total = sum(np.prod([chances[number[p]] for p in s], axis=0) for s in every_segmentation(number, b" " + w.encode()))
        assert np.allclose(got[words.index(w)], np.log(total), rtol=1e-9)


def test_expected_counts_equal_the_definition():
    vocab, rng = language.vocabulary(PIECES), np.random.default_rng(5)
    chances = rng.random((len(vocab.pieces), 2)) / len(vocab.pieces)
    words, counts = ["nation", "ation", "é"], np.array([[2.0, 1.0], [0.0, 3.0], [1.0, 0.0]])
    ends = np.cumsum([len(w.encode()) for w in words])
    data = np.frombuffer("".join(words).encode(), np.uint8)
    got = language.expected(vocab, *language.spell(data, ends - [len(w.encode()) for w in words], ends), counts, chances)
    number, want = {p: i for i, p in enumerate(vocab.pieces)}, np.zeros_like(got)
    for w, c in zip(words, counts):
        ways = [(s, np.prod([chances[number[p]] for p in s], axis=0)) for s in every_segmentation(number, b" " + w.encode())]
        total = sum(p for _, p in ways)
        for s, p in ways:
            for piece in s:
                want[number[piece]] += c * p / total
    assert np.allclose(got, want, rtol=1e-9)


def test_language_of_awkward_rows(spark):
    texts = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, "the dog and the house", "en"),
             (4, "das haus ist sehr schön", "de"), (5, None, "en"), (6, "", "de"), (7, " 12 :-) \n", "en"),
             (8, "words", None), (None, "the house", "en"), (1, "the cat sat on the mat", "en"),
             (9, "das" * 40_000, None), (10, "THE CAT, THE MAT!", None), (11, "漢字", None), (12, "́", None)]
    df = spark.createDataFrame([(*t, "x", 1) for t in texts],
                               "doc_id long, text string, lang string, lang_pred string, _said int").repartition(3)
    model = language.train(df, PIECES)
    out = language.predict(df, model)
    assert sorted(out.columns) == sorted([*df.columns, "score"])
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert len(got) == len(texts) - 1
    for (i, text), (said, score) in got.items():
        assert 0 <= score <= 1
        if i in (5, 6, 7, 12):
            assert (said, score) == ("und", 0.0)
        elif i != 11:
            assert said == ("de" if i in (2, 4, 9) else "en")
    assert got[11, "漢字"][0] in ("de", "en")
    assert language.predict(df.limit(0), model).count() == 0
    nothing = language.train(df.where("lang IS NULL"), PIECES)
    assert {(r.lang_pred, r.score) for r in language.predict(df, nothing).collect()} == {("und", 0.0)}


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    learn = fold("doc_id", 3) != 1
    model = language.train(docs.where(learn), PIECES, sample=20)
    held = language.predict(docs.where(~learn), model).collect()
    assert len(held) > 250 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert {zlib.crc32(str(r.doc_id).encode()) % 3 for r in held} == {1}
    words = language.predict(docs.where(~learn).select(F.substring_index("text", " ", 6).alias("text"), "lang"), model).collect()
    assert sum(r.lang == r.lang_pred for r in words) >= 0.9 * len(words)
