"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of about equal size.  A block has a bitmap over its documents for
every bit of their signatures: a term sets three bits of its document, and further three for each level of
``LEVELS`` that its number of occurrences reaches.  The intersection of a query term's bitmaps shows where
it *may* occur, and how often at most; so the weighted sums of the intersections, level by level,
are upper bounds of all documents' scores (bit slices as in Goodwin et al., 2017).

A search takes the documents with the largest bounds, scores them exactly from their texts, and so knows
a score that the ``k``-th best reaches.  Every document whose bound is not below it is then scored
exactly.  Of documents with equal texts, which score alike, the ``k`` smallest ids can be in a result.
False positives cost time, never a row.

Scores (all 64-bit integers): a term's weight is ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``; a document
with ``n`` terms has ``m = 10 + (90 * n * N) div L`` and scores the sum of ``w * ((10**9 * tf) div (1000 * tf +
8 * m))`` over the query's distinct terms.  ``N`` documents hold a term, ``L`` terms in all, ``df`` documents
hold the one, ``tf`` times in this document.  Terms are named by 64-bit hashes (see ``text``).

The index is built in one pass without a shuffle.  Queries are taken in packs of about ``PACK_BYTES``, which
bounds what a task and the driver know of them; each pack reads the index three times.

Rows: null and empty texts hold no term and are never found.  Rows with equal query id are one query
with the terms of all of them (null is an id, too); a query without terms, or whose terms no document holds,
has no rows.  Repeated documents are documents of their own; ties go to the smaller id, null last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import text_bytes, whole_text, written
from fleetlens.llm.text import mix, pieces, word_hashes
from fleetlens.plans.durable import scratch_path

TOP = 10
#: documents per query that are scored to find what the k-th best reaches
PROBES = 32
#: numbers of occurrences that set further bits
LEVELS = (1, 2, 3, 5, 9, 17, 33, 65)
#: bits per entry of a signature at least, and of a block at most (unless one document needs more)
BITS_PER_ENTRY, BLOCK_BITS, BLOCK_ROWS = 16, 1 << 23, 4096
PIECE_BYTES = 1 << 19
PACK_BYTES = 1 << 20

_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_U = np.uint64
BLOCK = ("bits int, ids array<{kind}>, digests binary, sizes binary, tops binary, slices binary, terms binary,"
         " holders binary, n_docs long, n_terms long")


def term_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, first term of each text): runs of ASCII letters, digits and other characters
    beyond ASCII, A-Z lowered."""
    return word_hashes(offsets, data, space=_OTHER)


def _entry(hashes: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes + _U(level) * _U(0xA24BAED4963EE407)) if level else hashes


def _positions(entries: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(entries >> _U(s)) & _U(bits - 1) for s in (0, 21, 42)]).astype(np.int64)


@dataclass
class _Class:
    """Documents that wait for a block, all with signatures of the same size."""

    bits: int
    ids: list = field(default_factory=list)
    digests: list = field(default_factory=list)
    sizes: list = field(default_factory=list)
    tops: list = field(default_factory=list)
    hashes: list = field(default_factory=list)
    entries: list = field(default_factory=list)

    def full(self) -> bool:
        return len(self.ids) >= min(BLOCK_ROWS, max(8, BLOCK_BITS // self.bits))

    def block(self, kind: pa.DataType) -> pa.RecordBatch:
        width = -(-len(self.ids) // 8) * 8
        cells = np.zeros((self.bits, width), bool)
        for row, entries in enumerate(self.entries):
            cells[_positions(entries, self.bits), row] = True
        terms, holders = np.unique(np.concatenate(self.hashes), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.bits], pa.int32()), pa.array([self.ids], pa.list_(kind))]
            + [pa.array([b], pa.binary()) for b in (
                b"".join(self.digests), np.array(self.sizes, "<i8").tobytes(), np.array(self.tops, "<i8").tobytes(),
                np.packbits(cells, axis=1).tobytes(), terms.astype("<u8").tobytes(), holders.astype("<i8").tobytes())]
            + [pa.array([n], pa.int64()) for n in (len(self.ids), sum(self.sizes))],
            ["bits", "ids", "digests", "sizes", "tops", "slices", "terms", "holders", "n_docs", "n_terms"])


def _blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, _Class] = {}
    for batch in batches:
        ids, digests = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
        for first, end, offsets, data in pieces(batch.column("_text"), PIECE_BYTES):
            hashes, first_term = term_hashes(offsets, data)
            for i in range(end - first):
                own = hashes[first_term[i]:first_term[i + 1]]
                if not len(own):
                    continue
                distinct, tf = np.unique(own, return_counts=True)
                entries = np.concatenate([_entry(distinct[tf >= n], level) for level, n in enumerate(LEVELS)])
                bits = 1 << max(6, math.ceil(math.log2(BITS_PER_ENTRY * len(entries))))
                to = waiting.setdefault(bits, _Class(bits))
                to.ids.append(ids[first + i])
                to.digests.append(digests[first + i])
                to.sizes.append(len(own))
                to.tops.append(int(tf.max()))
                to.hashes.append(distinct)
                to.entries.append(entries)
                if to.full():
                    yield waiting.pop(bits).block(kind)
    for rest in waiting.values():
        yield rest.block(kind)


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the text without nulls, and its digest, by which equal texts are known."""
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("_text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.col("_text").cast("binary"))))


def build_index(docs: DataFrame) -> DataFrame:
    """One row per block of documents; ``docs`` is from ``digested``.  Texts without a term are left out."""
    kind = docs.schema["doc_id"].dataType
    arrow = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type

    def build(batches):
        return _blocks(batches, arrow)

    return written(docs.mapInArrow(build, BLOCK.format(kind=kind.simpleString())), "blocks")


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 10**9 * tf // (1000 * tf + 8 * m)


@dataclass
class Pack:
    """Some queries: their distinct terms in order, each query's terms among them, and the terms' weights."""

    terms: np.ndarray
    of: list[np.ndarray]
    n_docs: int
    n_terms: int
    weights: np.ndarray | None = None

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        return 10 + 90 * sizes * self.n_docs // self.n_terms

    def count(self, terms: np.ndarray, holders: np.ndarray) -> np.ndarray:
        """Documents of a block that hold each term of the pack."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        return np.where(terms[at] == self.terms, holders[at], 0)

    def bounds(self, bits: int, sizes: np.ndarray, tops: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """An upper bound of every query's score of every document of a block, exact to one part in 10**12."""
        lengths, n = self.lengths(sizes), len(sizes)
        out, before = np.zeros((len(self.of), n)), np.zeros(n, np.int64)
        active, held = np.flatnonzero(self.weights > 0), None
        for level in range(len(LEVELS)):
            at = _positions(_entry(self.terms[active], level), bits)
            here = slices[at[0]] & slices[at[1]] & slices[at[2]]
            if held is not None:
                here &= held
            some = here.any(1)
            active, held = active[some], here[some]
            if not len(active):
                break
            most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else np.iinfo(np.int32).max
            now = gain(np.minimum(most, tops), lengths)
            more, before = (now - before).astype(float), now
            cells = np.unpackbits(held, axis=1)[:, :n]
            slot = np.full(len(self.terms), -1)
            slot[active] = np.arange(len(active))
            weights = self.weights[active].astype(float)
            for q, terms in enumerate(self.of):
                own = slot[terms]
                own = own[own >= 0]
                if len(own):
                    out[q] += (weights[own] @ cells[own]) * more
        return out

    def score(self, hashes: np.ndarray, queries: list[int]) -> list[int]:
        """Exact scores of one text."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        tf = np.bincount(at[self.terms[at] == hashes], minlength=len(self.terms))
        length = self.lengths(np.array([len(hashes)]))
        each = self.weights * gain(tf, length)
        return [int(each[self.of[q]].sum()) for q in queries]


def _parts(batches: Iterator[pa.RecordBatch]):
    """(bits, sizes, tops, slices, digests, ids) of every block."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = {c: batch.column(c)[row] for c in batch.schema.names}
            sizes, tops = (np.frombuffer(get[c].as_buffer(), "<i8") for c in ("sizes", "tops"))
            bits, raw = get["bits"].as_py(), get["digests"].as_py()
            yield (bits, sizes, tops, np.frombuffer(get["slices"].as_buffer(), np.uint8).reshape(bits, -1),
                   [raw[i:i + 16] for i in range(0, len(raw), 16)], get["ids"].values if "ids" in get else None)


def _document_counts(blocks: DataFrame, pack: Pack) -> np.ndarray:
    def count(batches):
        sums = np.zeros(len(pack.terms), np.int64)
        for batch in batches:
            for terms, holders in zip(batch.column("terms"), batch.column("holders")):
                sums += pack.count(np.frombuffer(terms.as_buffer(), "<u8"), np.frombuffer(holders.as_buffer(), "<i8"))
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held, pa.int64()), "n": pa.array(sums[held], pa.int64())})

    rows = blocks.select("terms", "holders").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(pack.terms), np.int64)
    for r in rows.collect():  # at most the pack's terms
        out[r.term] = r.n
    return out


def _best_bounds(blocks: DataFrame, pack: Pack, probes: int) -> DataFrame:
    """``query, bound, digest`` of the documents with the largest bounds."""

    def best(batches):
        bound = np.zeros((len(pack.of), probes))
        names = np.full((len(pack.of), probes), b"", object)
        for bits, sizes, tops, slices, digests, _ in _parts(batches):
            new = pack.bounds(bits, sizes, tops, slices)
            both = np.concatenate([bound, new], 1)
            top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
            known = np.concatenate([np.full(probes, b"", object), np.array([*digests, b""], object)[:-1]])
            fresh = top >= probes
            names = np.where(fresh, known[top], np.take_along_axis(names, np.where(fresh, 0, top), 1))
            bound = np.take_along_axis(both, top, 1)
        query, at = np.nonzero(bound > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(bound[query, at], pa.float64()),
                                          pa.array(names[query, at].tolist(), pa.binary())], ["query", "bound", "digest"])

    rows = blocks.select("bits", "digests", "sizes", "tops", "slices").mapInArrow(
        best, "query int, bound double, digest binary")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "digest")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= probes).drop("_n")


def _candidates(blocks: DataFrame, pack: Pack, least: np.ndarray, k: int, kind: str) -> DataFrame:
    """``query, digest, doc_id`` of the documents whose bound reaches ``least``; of equal texts the ``k``
    smallest ids."""

    def find(batches):
        for bits, sizes, tops, slices, digests, ids in _parts(batches):
            bound = pack.bounds(bits, sizes, tops, slices)
            query, row = np.nonzero((bound > 0) & (bound * (1 + 1e-9) + 1 >= least[:, None]))
            if len(query) > k:  # rows of a query in the order of texts and ids; the first k of each text
                place = ids.to_pylist()
                by_id = sorted(range(len(place)), key=lambda i: (place[i] is None, place[i]))
                id_rank = np.empty(len(place), np.int64)
                id_rank[by_id] = np.arange(len(place))
                text = np.unique(np.array([*digests, b"x"], object), return_inverse=True)[1][:-1]
                order = np.lexsort((id_rank[row], text[row], query))
                query, row = query[order], row[order]
                key = query * len(digests) + text[row]
                first = np.searchsorted(key, key)
                keep = np.arange(len(key)) - first < k
                query, row = query[keep], row[keep]
            yield pa.RecordBatch.from_arrays([
                pa.array(query, pa.int32()), pa.array([digests[i] for i in row.tolist()], pa.binary()),
                ids.take(pa.array(row, pa.int64()))], ["query", "digest", "doc_id"])

    rows = blocks.select("bits", "ids", "digests", "sizes", "tops", "slices").mapInArrow(
        find, f"query int, digest binary, doc_id {kind}")
    order = Window.partitionBy("query", "digest").orderBy(F.asc_nulls_last("doc_id"))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _exact(pairs: DataFrame, docs: DataFrame, pack: Pack) -> DataFrame:
    """``query, digest, score`` of distinct pairs; every text among them is read and scored once."""
    asked = pairs.select("query", "digest").distinct().groupBy("digest").agg(F.collect_list("query").alias("queries"))
    texts = (docs.join(asked.select("digest"), "digest", "left_semi").groupBy("digest")
             .agg(F.max("_text").alias("_text")))

    def scored(batches):
        for batch in batches:
            out = {"query": [], "digest": [], "score": []}
            queries, digests = batch.column("queries").to_pylist(), batch.column("digest").to_pylist()
            for first, end, offsets, data in pieces(batch.column("_text"), PIECE_BYTES):
                hashes, first_term = term_hashes(offsets, data)
                for i in range(first, end):
                    own = hashes[first_term[i - first]:first_term[i - first + 1]]
                    out["query"] += queries[i]
                    out["digest"] += [digests[i]] * len(queries[i])
                    out["score"] += pack.score(own, queries[i])
            yield pa.RecordBatch.from_arrays([pa.array(out["query"], pa.int32()), pa.array(out["digest"], pa.binary()),
                                              pa.array(out["score"], pa.int64())], ["query", "digest", "score"])

    return asked.join(texts, "digest").mapInArrow(scored, "query int, digest binary, score long")


def _search(docs: DataFrame, blocks: DataFrame, pack: Pack, k: int, probes: int) -> DataFrame:
    """``query, rank, doc_id, score`` of one pack."""
    df = _document_counts(blocks, pack)
    pack.weights = np.array([math.floor(1000 * math.log((2 * pack.n_docs + 2) / (2 * n + 1))) if n else 0
                             for n in df.tolist()], np.int64)
    probed = written(_best_bounds(blocks, pack, max(probes, k)), "probed")
    reached: dict[int, list[int]] = {}
    for r in probed.join(_exact(probed, docs, pack), ["query", "digest"]).collect():  # ``probes`` rows a query
        reached.setdefault(r["query"], []).append(r.score)
    least = np.ones(len(pack.of))
    for query, scores in reached.items():
        if len(scores) >= k:
            least[query] = max(1, sorted(scores)[-k])
    found = written(_candidates(blocks, pack, least, k, docs.schema["doc_id"].dataType.simpleString()), "candidates")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.join(_exact(found, docs, pack), ["query", "digest"]).where("score > 0")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query", "rank", "doc_id", "score"))


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", probes: int = PROBES,
           pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for every item, best first."""
    spark = docs.sparkSession
    docs = digested(docs, key, text)
    asked = items.select(F.col(item_key).alias("item_id"), whole_text(item_text).alias("_text"))
    schema = f"item_id {items.schema[item_key].dataType.simpleString()}, rank int, doc_id " \
             f"{docs.schema['doc_id'].dataType.simpleString()}, score long"
    blocks = build_index(docs)
    n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    packs = -(-text_bytes(asked, "_text") // pack_bytes) if n_docs else 0
    path = scratch_path(spark, "ranked")
    spark.createDataFrame([], schema).write.parquet(path)
    for p in range(packs):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(packs)) == p).collect()  # about ``pack_bytes``
        names, of = [], {}
        for r in rows:
            if r.item_id not in of:
                names.append(r.item_id)
            for _, _, offsets, data in pieces(pa.array([r["_text"]])):
                of.setdefault(r.item_id, []).append(term_hashes(offsets, data)[0])
        every = [np.unique(np.concatenate(of[n])) for n in names]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]))
        if len(terms):
            pack = Pack(terms, [np.searchsorted(terms, own) for own in every], n_docs, n_terms)
            ids = spark.createDataFrame(list(enumerate(names)), f"query int, item_id {schema.split()[1][:-1]}")
            # one row per item of the pack
            (_search(docs, blocks, pack, k, probes).join(F.broadcast(ids), "query").drop("query")
             .select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)


# What separates terms, and the letters that are lowered
SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM
 (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
n AS MATERIALIZED (SELECT r, CAST(sum(tf) AS BIGINT) AS size FROM t GROUP BY r),
s AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS terms FROM n),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM
 (SELECT term, count(*) AS df FROM t GROUP BY term), s),
i AS MATERIALIZED (SELECT DISTINCT item_id, term FROM
 (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
p AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * docs) // terms)))) AS BIGINT) AS score
 FROM i JOIN t USING (term) JOIN w USING (term) JOIN n USING (r), s GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM p JOIN d USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
