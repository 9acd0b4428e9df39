"""Log-probabilities of whole texts under a bigram model, read off a weighted backoff automaton.

States are the histories (a word, or the text's edge); a state has an arc for every word seen behind
it in training, and one failure arc to the root, which has an arc for every word.  With absolute
discounting, ``c`` counts, ``t`` the number of different words behind a history, and ``D`` estimated
from the corpus as ``n1 / (n1 + 2 * n2)`` over its bigrams that occur once and twice, with ``n1`` at least
1, so that unseen bigrams keep some probability where none occurs once (every row twice, say):

    root:      p(w)     = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    failure:   f(h)     = D * t(h) / c(h)
    arc:       p(w | h) = (c(h, w) - D) / c(h) + f(h) * p(w)

A text is one left-to-right walk that carries its state: take the arc of the next word if the state has one,
else the failure arc and the root's arc, go to that word's state, and add the logarithms; the end of the text
is a word.  A state that was never seen in training is the root itself.  The texts of a block walk side
by side, a step of all of them at a time.

The counts cover all training texts and grow with them, so no task and no driver holds the model.
Texts are dealt into blocks of about ``BLOCK_BYTES``.  A block names each of its bigrams once to the
shard that owns it, with its own count; a shard adds up what all blocks say and answers
each block; a block then holds just the states and arcs its texts can visit.  Shards are ranges of
the hash of the history; histories that are frequent in a sample of texts are spread over all
shards by the hash of the following word, and their parts add up in the block.  (The sample only
decides which shard counts what.)  Lists travel compressed: sorted keys as differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import text_bytes, whole_text
from fleetlens.llm.text import pieces, word_hashes

BLOCK_BYTES = 16 << 20
HOT_WORDS = 64
HOT_SAMPLE = 2000
EDGE = np.uint64(0x51ED270B0A1F3D2C)  # the end of a text, which is also the state at its start
_WORD_BITS = np.uint64(16)  # the key of a following word is its hash without the lowest 16 bits


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed; planes of equal bytes cost next to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    flat = np.frombuffer(pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).view("<u8").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def _range_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash: equal ranges of its upper half, so sorted hashes have sorted shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Block:
    """The bigrams of some texts: histories in order, and the words behind each in order."""

    def __init__(self, texts: pa.Array, learn: np.ndarray, hot: np.ndarray):
        words, tokens_of = [], []
        for first, end, offsets, data in pieces(texts):
            hashes, first_word = word_hashes(offsets, data)
            n = np.diff(first_word)
            out = np.full(len(hashes) + end - first, EDGE)
            out[np.arange(len(hashes)) + np.repeat(np.arange(end - first), n)] = hashes
            words.append(out)
            tokens_of.append(n + 1)
        self.tokens_of = np.concatenate(tokens_of) if tokens_of else np.zeros(0, np.int64)
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        # every block asks about every hot word, so that each can count the different words
        self.vocabulary, word = np.unique(np.concatenate([words, hot, [EDGE]]), return_inverse=True)
        edge, self.word = word[-1], word[:len(words)]
        before = np.concatenate([[edge], self.word[:-1]])  # the token before a text's first is an end
        pair = before.astype(np.int64) << 32 | self.word
        self.edge = int(edge)
        self.pairs, which = np.unique(pair, return_inverse=True)
        weight = np.repeat(learn, self.tokens_of).astype(np.float64)
        self.counts = np.bincount(which, weight, minlength=len(self.pairs)).astype(np.uint64)
        self.history, self.follower = self.pairs >> 32, self.pairs & 0xFFFFFFFF

    def cut(self, shards: int, hot: np.ndarray):
        """For each shard, the index of its pairs in order, and of the histories it is asked about.

        A shard is asked about all hot histories of the block, whether or not a pair of them is its own.
        """
        is_hot = np.isin(self.vocabulary, hot)
        by_history = _range_of(self.vocabulary, shards)
        spread = is_hot[self.history]
        shard = np.where(spread, _range_of(self.vocabulary[self.follower], shards), by_history[self.history])
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        hot_here, cold = np.flatnonzero(is_hot), np.flatnonzero(~is_hot)
        cold_ends = np.searchsorted(by_history[cold], np.arange(shards + 1))
        for s in range(shards):
            asked = np.union1d(cold[cold_ends[s]:cold_ends[s + 1]], hot_here)
            yield s, order[ends[s]:ends[s + 1]], asked


def _requests(block: int, texts: pa.Array, learn: np.ndarray, shards: int, hot: np.ndarray):
    b = Block(texts, learn, hot)
    rows = {k: [] for k in ("shard", "block", "histories", "runs", "followers", "counts")}
    for s, pairs, asked in b.cut(shards, hot):
        rows["shard"].append(s)
        rows["block"].append(block)
        rows["histories"].append(_pack_sorted(b.vocabulary[asked]))
        runs = np.bincount(np.searchsorted(asked, b.history[pairs]), minlength=len(asked))
        rows["runs"].append(_pack(runs.astype(np.uint64)))
        rows["followers"].append(_pack(b.vocabulary[b.follower[pairs]] >> _WORD_BITS))
        rows["counts"].append(_pack(b.counts[pairs]))
    return rows


def _read(row: dict) -> tuple[np.ndarray, ...]:
    histories, runs = _unpack_sorted(row["histories"]), _unpack(row["runs"]).astype(np.int64)
    return histories, runs, _unpack(row["followers"]), _unpack(row["counts"])


def _answers(rows: list[dict], hot: np.ndarray):
    """What one shard knows: per asked history its count and different words here, per asked pair its
    count, and the shard's totals."""
    each = [_read(r) for r in rows]
    vocabulary = np.unique(np.concatenate([h for h, *_ in each]))
    where = [np.searchsorted(vocabulary, h) for h, *_ in each]
    h = np.concatenate([np.repeat(w, runs) for w, (_, runs, _, _) in zip(where, each)])
    w = np.concatenate([f for *_, f, _ in each])
    c = np.concatenate([n for *_, n in each]).astype(np.int64)
    order = np.lexsort((w, h))
    h, w, c = h[order], w[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    count = np.bincount(h[first], total, minlength=len(vocabulary)).astype(np.uint64)
    types = np.bincount(h[first], total > 0, minlength=len(vocabulary)).astype(np.uint64)
    cold = ~np.isin(vocabulary, hot)
    totals = np.array([count.sum(), (cold & (count > 0)).sum(), (total == 1).sum(), (total == 2).sum()], np.uint64)
    at = 0
    for row, place, (_, runs, _, _) in zip(rows, where, each):
        n = int(runs.sum())
        yield {"block": row["block"], "shard": row["shard"], "count": _pack(count[place]), "types": _pack(types[place]),
               "pairs": _pack(total[back[at:at + n]].astype(np.uint64)), "totals": totals.tobytes()}
        at += n


class Automaton:
    """The states and arcs that the texts of one block can visit."""

    def __init__(self, block: Block, answers: dict[int, dict], shards: int, hot: np.ndarray):
        self.block = block
        c, t = np.zeros(len(block.vocabulary)), np.zeros(len(block.vocabulary))
        pair, totals = np.zeros(len(block.pairs)), np.zeros(4)
        for s, pairs, asked in block.cut(shards, hot):
            a = answers[s]
            c[asked] += _unpack(a["count"])
            t[asked] += _unpack(a["types"])
            pair[pairs] = _unpack(a["pairs"])
            totals += np.frombuffer(a["totals"], np.uint64)
        self.n, v = totals[0], totals[1] + (c[np.isin(block.vocabulary, hot)] > 0).sum()
        once = max(totals[2], 1)
        discount = once / (once + 2 * totals[3])
        self.known = c > 0
        root = (c + 0.5) / (self.n + 0.5 * (v + 1))
        at = np.maximum(c, 1)
        failure = np.where(c > 0, discount * t / at, 1.0)
        # arcs of the states that training saw, by state and word; the last state is the root, which has no such
        # arcs, fails to itself, and has an arc for every word
        seen = np.flatnonzero(pair > 0)
        h, w = block.history[seen], block.follower[seen]
        self.arcs = block.pairs[seen]
        self.arc_weight = np.log10(np.maximum(pair[seen] - discount, 0) / at[h] + failure[h] * root[w])
        self.failure_weight = np.append(np.log10(failure), 0.0)
        self.root_weight = np.log10(root)
        self.state_of = np.where(self.known, np.arange(len(c)), len(c))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of taking one word from each state."""
        weight = self.failure_weight[state] + self.root_weight[word]
        if len(self.arcs):
            key = state << 32 | word
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            weight = np.where(self.arcs[at] == key, self.arc_weight[at], weight)
        return weight, self.state_of[word]

    def walk(self) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base, score) of each text: the sums along its walk."""
        b = self.block
        first = np.cumsum(b.tokens_of) - b.tokens_of
        if not len(first):
            return tuple(np.zeros(0) for _ in range(4))
        order = np.argsort(-b.tokens_of, kind="stable")  # the longest first, so that those under way stay in front
        ahead, score = first[order], np.zeros(len(order))
        state = np.full(len(order), self.state_of[b.edge])
        under_way = len(order) - np.searchsorted(b.tokens_of[order][::-1], np.arange(b.tokens_of.max()), "right")
        for place, n in enumerate(under_way.tolist()):
            weight, state[:n] = self.step(state[:n], b.word[ahead[:n] + place])
            score[:n] += weight
        out = np.empty(len(order))
        out[order] = score
        return (b.tokens_of, np.add.reduceat(self.known[b.word].astype(np.int64), first),
                np.add.reduceat(self.root_weight[b.word], first), out)


def _hot_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of a bounded sample of texts, and the edge."""
    some = docs.select("_text").limit(HOT_SAMPLE)
    words = (some.select(F.explode(F.split(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r",
                                                       "abcdefghijklmnopqrstuvwxyz     "), " ")).alias("w"))
             .where("w <> ''").groupBy("w").count().orderBy(F.desc("count"), "w").limit(HOT_WORDS).collect())
    flat = pa.array([r.w for r in words], pa.string())
    found = [word_hashes(offsets, data)[0] for _, _, offsets, data in pieces(flat)]
    return np.unique(np.concatenate([*found, np.array([EDGE])]))


def score_texts(docs: DataFrame, learn: Column, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``learnt``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows for which ``learn`` holds are learnt from; all are scored.  Null and empty texts are just
    their end.  Repeated rows count as often as they occur.  With nothing to learn from, every token has
    the probability of an unseen one.  Both uses of a block read the same shuffle of the texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(learn, F.lit(False)).alias("learnt"), whole_text(text).alias("_text"))
    blocks = max(1, -(-text_bytes(docs, "_text") // block_bytes))
    shards = max(1, blocks // 2)
    hot = _hot_words(docs)
    dealt = (docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(blocks)).cast("int"))
             .repartition(blocks, "block"))

    def ask(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = _requests(key[0].as_py(), group.column("_text"), np.asarray(group.column("learnt")), shards, hot)
        return pa.table({"shard": pa.array(rows["shard"], pa.int32()), "block": pa.array(rows["block"], pa.int32())}
                        | {k: pa.array(rows[k], pa.binary()) for k in ("histories", "runs", "followers", "counts")})

    def answer(group: pa.Table) -> pa.Table:
        rows = list(_answers(group.to_pylist(), hot))
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int32()),
                         "shard": pa.array([r["shard"] for r in rows], pa.int32())}
                        | {k: pa.array([r[k] for r in rows], pa.binary()) for k in ("count", "types", "pairs", "totals")})

    def walk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts.column("_text"), np.asarray(texts.column("learnt")), hot)
        automaton = Automaton(block, {r["shard"]: r for r in answers.to_pylist()}, shards, hot)
        n, known, base, score = automaton.walk()
        return pa.table({"doc_id": texts.column("doc_id"), "learnt": texts.column("learnt"),
                         "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()),
                         "train_tokens": pa.array(np.full(len(n), int(automaton.n)), pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    asked = dealt.groupBy("block").applyInArrow(
        ask, "shard int, block int, histories binary, runs binary, followers binary, counts binary")
    told = asked.repartition(shards, "shard").groupBy("shard").applyInArrow(
        answer, "block int, shard int, count binary, types binary, pairs binary, totals binary")
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        walk, f"doc_id {kind}, learnt boolean, n_tokens long, n_known long, train_tokens long,"
              " base_score double, score double")
