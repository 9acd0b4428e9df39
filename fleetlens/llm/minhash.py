"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard on full shingle sets.

Signatures take two permutations of ``UNIVERSE`` places (Li and Li, 2022): the first scatters a
text's shingles, the second, shifted circularly by 0, 1, 2, ..., gives one coordinate per shift, so a
shingle's part in all coordinates is one slice of a table.  Bands of ``ROWS`` coordinates make
buckets; two texts at similarity 0.8 share none of ``BANDS`` buckets with probability
``(1 - 0.8**6)**40 = 5e-6``, and less above.

No step emits all pairs of a bucket:

* texts with equal shingle sets are one class, represented by its smallest id;
* in a round of stars each class is compared with one member of its buckets, chosen by a hash that
  changes with the round (the smallest, in the first round), and links found are contracted, so a
  large group of near copies collapses within a few rounds;
* what is left, classes with bucket mates in other components that they have not been compared with,
  is compared by an exact prefix join: a set at similarity 0.8 to another shares one of any fifth of
  its shingles with it, so the rarest fifth is looked up.  Common passages are not rare, so they pair
  nothing.

Every link is confirmed on the full sets.  Sets are 64-bit hashes of lower-cased words.  No pair is
compared twice, and texts, sets and band keys move only if a bitmap of fixed size says that they may
be needed; exact joins follow.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import maybe_among, whole_text, written
from fleetlens.llm.components import as_links, components
from fleetlens.llm.text import mix, pieces, windows, word_hashes

SHINGLE = 4
PERCENT = 80
UNIVERSE = 1 << 20
BANDS, ROWS = 40, 6
STAR_ROUNDS = 4
LOOK_BACK = 16
_BLOCK = 2048


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """(first permutation, slices of the second: row i holds the places i, i + 1, ... around the circle)"""
    rng = np.random.default_rng(7)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    circle = np.concatenate([second, second[:BANDS * ROWS]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, BANDS * ROWS)


def shingles(offsets: np.ndarray, data: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, of none nothing."""
    words, first_word = word_hashes(offsets, data)
    value, first = windows(words, first_word, n)
    out = []
    for i in range(len(offsets) - 1):
        m = first_word[i + 1] - first_word[i]
        if m >= n:
            out.append(np.unique(value[first[i]:first[i + 1]]))
        elif m:
            short, _ = windows(words[first_word[i]:first_word[i + 1]], np.array([0, m]), int(m))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """All coordinates of one non-empty set."""
    first, slices = _permutations()
    at = first[(mix(shingle_set) & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = np.full(BANDS * ROWS, UNIVERSE, np.int32)
    for i in range(0, len(at), _BLOCK):
        np.minimum(out, slices[at[i:i + _BLOCK]].min(0), out=out)
    return out


def _band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A key per text and band; the number of the band is part of it."""
    bands = coordinates.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + bands[:, :, i])
    return key.ravel().view(np.int64)


def describe(text: Column, words: int = SHINGLE) -> Column:
    """Struct of set size, digest of the set, and band keys (the band is part of the key)."""

    @F.arrow_udf("struct<n:bigint,digest:binary,bands:array<bigint>>")
    def described(texts: pa.Array) -> pa.Array:
        sizes, digests, keys = [], [], []
        for _, _, offsets, data in pieces(texts):
            found = shingles(offsets, data, words)
            sizes += [len(one) for one in found]
            digests += [hashlib.blake2b(one.tobytes(), digest_size=16).digest() for one in found]
            if any(len(one) for one in found):
                keys.append(_band_keys(np.stack([signature(one) for one in found if len(one)])))
        ends = np.concatenate([[0], np.cumsum([BANDS if n else 0 for n in sizes])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["n", "digest", "bands"])

    return described(text)


def shingle_set(text: Column, words: int = SHINGLE) -> Column:
    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        out = [one for _, _, offsets, data in pieces(texts) for one in shingles(offsets, data, words)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return sets(text)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` whose full sets reach the similarity.

    A class that very many pairs name has one set, so Spark can split its pairs over tasks.
    """
    named = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    sets = maybe_among(sets, "rep", named)
    one = sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    return (pairs.join(one, "a").join(two, "b")
            .where(100 * both >= PERCENT * (F.size("items_a") + F.size("items_b") - both))
            .select("a", "b").distinct())


def _with_parts(buckets: DataFrame, place: DataFrame) -> DataFrame:
    return buckets.join(place, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")


def _pair(one: str, two: str) -> list[Column]:
    return [F.greatest(one, two).alias("a"), F.least(one, two).alias("b")]


def _star_pairs(buckets: DataFrame, place: DataFrame | None, turn: int, tried: DataFrame | None = None) -> DataFrame:
    """Each class with at most one bucket mate of another component, in no pair of ``tried``.

    Every bucket offers its first two components in the order of this turn, so that a member of the
    first is offered the second.  A class takes the first of all its offers.
    """
    rank = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    now = buckets.withColumn("part", F.col("rep")) if place is None else _with_parts(buckets, place)
    now = now.select("key", "rep", "part", rank.alias("rank"))
    lead = now.groupBy("key").agg(F.min(F.struct("rank", "part", "rep")).alias("lead"))
    offers = now.join(lead, "key").where("part <> lead.part").select("rep", "lead.rank", F.col("lead.rep").alias("other"))
    if tried is not None:
        offers = offers.distinct().select("rep", "rank", "other", *_pair("rep", "other")).join(
            tried, ["a", "b"], "left_anti")
    best = offers.groupBy("rep").agg(F.min(F.struct("rank", "other")).alias("best"))
    return best.select(*_pair("rep", "best.other")).distinct()


def _open_classes(buckets: DataFrame, place: DataFrame, tried: DataFrame) -> DataFrame:
    """Classes that share a bucket with another component, with their component; ``light`` says that
    in one of these buckets theirs is not the most frequent component.

    Buckets whose pairs of different components are all among the distinct pairs ``tried (a, b)`` don't count.
    """
    now = _with_parts(buckets, place)
    most = (now.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts"),
                                F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("within"))
            .where("parts > 1").select("key", F.col("most.part").alias("top"), "size",
                                       F.expr("(size * size - within) div 2").alias("across")))
    # a round tries at most one pair a class, so larger buckets can't be done
    small = now.join(most.where(F.col("across") <= STAR_ROUNDS * F.col("size")).select("key"), "key", "left_semi")
    one = small.select("key", F.col("rep").alias("a"), F.col("part").alias("part_a"))
    two = small.select("key", F.col("rep").alias("b"), F.col("part").alias("part_b"))
    met = (tried.join(one, "a").join(two, ["key", "b"]).where("part_a <> part_b")
           .groupBy("key").agg(F.count(F.lit(1)).alias("met")))
    undone = most.join(met, "key", "left").where("met IS NULL OR met < across").select("key", "top")
    return (now.join(undone, "key").groupBy("rep", "part")
            .agg(F.max(F.col("part") != F.col("top")).alias("light")))


def _prefix_pairs(open_sets: DataFrame) -> DataFrame:
    """Pairs of classes in different components that may be similar.

    Of two classes in a bucket and in different components, one is light.  With all shingles in one
    order, rare ones first, a set of n shares at least t * n with a set at similarity t, so the first
    shingle they share is among the first n - ceil(t * n) + 1 of both.  Pairs that meet there must
    also fit in size, and by the places of that shingle among the shingles of more than one set:
    what both have before it and behind it bounds what they can share.
    """
    items = open_sets.select("rep", "part", "light", "which", F.size("items").alias("n"),
                             F.explode("items").alias("item"))
    # shingles of one component only come first and pair nothing
    seen = (items.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("part").alias("lo"),
                                      F.max("part").alias("hi")).where("lo <> hi").select("item", "df"))
    floor = F.floor((PERCENT * F.col("n") + 99) / 100).cast("int")
    alone = F.col("n") - F.size("order")
    prefix = written(items.join(seen, "item").groupBy("rep", "part", "light", "which", "n")
              .agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("order"))  # the set of one text
              .where(F.size("order") >= floor)
              .select("rep", "part", "light", "n", F.size("order").alias("m"), F.explode(F.transform(
                  F.slice("order", F.lit(1), F.greatest(F.col("n") - floor + 1 - alone, F.lit(0))),
                  lambda x, i: F.struct(x["item"].alias("item"), (i + 1).alias("at"), F.transform(
                      F.slice("order", F.greatest(i - (LOOK_BACK - 1), F.lit(1)), F.least(i, F.lit(LOOK_BACK))),
                      lambda y: y["item"]).alias("before")))).alias("x"))
              .select("rep", "part", "light", "n", "m", "x.*"), "prefixes")
    left, right = prefix.where("light").alias("l"), prefix.alias("r")
    most = F.least("l.at", "r.at") + F.least(F.col("l.m") - F.col("l.at"), F.col("r.m") - F.col("r.at"))
    return (left.join(right, (F.col("l.item") == F.col("r.item")) & (F.col("l.part") != F.col("r.part"))
                      & (100 * F.least("l.n", "r.n") >= PERCENT * F.greatest("l.n", "r.n"))
                      & ((100 + PERCENT) * most >= PERCENT * (F.col("l.n") + F.col("r.n")))
                      # met at an earlier shingle already
                      & ~F.arrays_overlap("l.before", "r.before"))
            .select(F.greatest("l.rep", "r.rep").alias("a"), F.least("l.rep", "r.rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``; shingles have so many ``words``.

    Null texts are empty; empty texts link with nothing.  Rows that share a doc_id are one document
    (linked, whatever their texts).  Rows without an id take no part: no component, and kept.
    """
    described = docs.select("doc_id", describe(whole_text(text), words).alias("d")).select("doc_id", "d.*")
    table = written(described, "signatures")
    named = table.where("doc_id IS NOT NULL AND n > 0")
    # equal sets have equal bands, so any one will do
    reps = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    exploded = reps.select("rep", F.explode("bands").alias("key"))
    shared = written(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    # inner joins, as Spark would put a semi join below the bitmap's
    buckets = written(maybe_among(exploded, "key", shared).join(shared, "key").select("key", "rep").distinct(), "buckets")
    involved = buckets.select("rep").distinct()
    sets = written(maybe_among(docs.select(F.col("doc_id").alias("rep"), whole_text(text).alias("_text")), "rep", involved)
                   .join(involved, "rep")
                   # an id with several texts has a set for each
                   .groupBy("rep", F.xxhash64("_text").alias("which")).agg(F.first("_text").alias("_text"))
                   .select("rep", "which", shingle_set(F.col("_text"), words).alias("items")), "sets")
    tried = written(_star_pairs(buckets, None, 0), "pairs")
    links = written(confirmed(tried, sets), "found")
    place = components(links).withColumnRenamed("node", "rep")
    for turn in range(1, STAR_ROUNDS):
        pairs = written(_star_pairs(buckets, place, turn, tried), "pairs")
        tried = tried.unionByName(pairs)
        found = written(confirmed(pairs, sets), "found")
        if found.isEmpty():
            break
        place = components(as_links(place, "rep").unionByName(found)).withColumnRenamed("node", "rep")
    rest = written(_open_classes(buckets, place, tried), "rest")
    left = written(maybe_among(sets, "rep", rest.select("rep")).join(rest, "rep"), "open")
    pairs = written(_prefix_pairs(left).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = as_links(place, "rep").unionByName(written(confirmed(pairs, sets), "found"))
    # a document with several texts holds their classes together
    member = named.select("doc_id", "digest").distinct().join(reps.select("digest", "rep"), "digest")
    split = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    tied = member.join(split.select("doc_id", "lo"), "doc_id").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    place = components(links.unionByName(tied)).withColumnRenamed("node", "rep")
    owner = (reps.select("digest", "rep").join(place, "rep", "left")
             .select("digest", F.coalesce("component", "rep").alias("component_id")))
    out = (table.select("doc_id", "digest", F.col("n").alias("n_shingles"))
           .join(owner, "digest", "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(
               F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")))))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """One document of each group, with its own columns; copies of a row with an id stay once."""
    kept = near_duplicates(docs, text, words).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    # both steps deal by doc_id, so the texts move once
    return (docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            .unionByName(docs.where("doc_id IS NULL")).select(*docs.columns))
