"""Language of whole texts, by unigram models over a fixed vocabulary of pieces, summed over all segmentations.

Texts are lowered and cut to words of letters; a word is spelt as a space and its bytes.  Every language has
one probability for each piece: the letter pieces of a public vocabulary file of up to ``PIECE_BYTES`` bytes,
and all single bytes, so that every word has a segmentation.  A word's probability is the sum over *all* its
segmentations of the product of their pieces' probabilities, found by a forward algorithm over its bytes; a
text's is the product over its words, as no piece crosses a space.  The language with the largest posterior
is predicted, and the posterior is the score.

Learning: the rows of every language are counted (its smoothed share is the prior); about ``sample`` texts of
each, those with the smallest hash of id and text, give counts per word, and ``ROUNDS`` rounds of
expectation-maximisation over those words, spread over the tasks, give the pieces' probabilities.  Counts are
smoothed towards those of all languages together.  What reaches the driver is one number per piece
and language.  To learn, words beyond ``LEARN_BYTES`` are cut; to score, they are taken whole.

Rows: a null text and one without a letter are ``und`` with score 0; so is every text where nothing was
learnt.  Equal probabilities go to the language that sorts first.  Rows without a language teach nothing;
repeated rows count as often as they occur.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import whole_text, written
from fleetlens.llm.text import _hash_spans, hash_spans, pieces, word_spans

SAMPLE = 2000
ROUNDS = 3
PIECE_BYTES = 24
LEARN_BYTES = 24
#: pseudo-counts: of every piece over all languages, and of the pieces of all languages in each
EVEN, SHARED = 0.1, 1000.0
#: 25 bytes of this probability still are a double
LEAST = 1e-11
TEXT_BYTES = 1 << 19
#: numbers that a table of known words, and the states of words side by side, may hold
CACHE_CELLS, STATE_CELLS = 1 << 21, 1 << 21
UNDETERMINED = "und"


class Vocabulary:
    """Pieces as byte strings, found from their hashes; ``prefixes`` tell when no longer piece can match."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                text = model.id_to_piece(i).replace("▁", " ")
                letters = text[1:] if text.startswith(" ") else text
                if letters.isalpha() and text == text.lower() and len(text.encode()) <= PIECE_BYTES:
                    found.add(text.encode())
        self.pieces = sorted(found)
        number = {p: i for i, p in enumerate(self.pieces)}
        self.single = np.array([number[bytes([b])] for b in range(256)])
        prefixes = sorted({p[:n] for p in self.pieces for n in range(2, len(p) + 1)})
        ends = np.cumsum([len(p) for p in prefixes])
        keys = hash_spans(np.frombuffer(b"".join(prefixes), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.piece = np.array([number.get(p, -1) for p in prefixes])[order]

    def arcs(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every piece in every word; bytes are numbered from the word's first."""
        word_of = np.repeat(np.arange(len(size)), size)
        left = np.repeat(begin + size, size) - np.arange(len(flat))
        at, n, piece = [np.arange(len(flat))], [np.ones(len(flat), np.int64)], [self.single[flat]]
        active = np.arange(len(flat))
        for length in range(2, PIECE_BYTES + 1):
            active = active[left[active] >= length]
            if not len(active):
                break
            keys = _hash_spans(flat, active, active + length)
            slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[slot] == keys
            active, slot = active[hit], slot[hit]
            real = self.piece[slot] >= 0
            at.append(active[real])
            n.append(np.full(int(real.sum()), length))
            piece.append(self.piece[slot[real]])
        at, n, piece = map(np.concatenate, (at, n, piece))
        word = word_of[at]
        start = at - begin[word]
        return word, start, start + n, piece


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte, size) of words with a space before each."""
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    flat = np.full(int(size.sum()), 0x20, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[begin] = False
    place = np.arange(len(flat)) - np.repeat(begin, size) - 1 + np.repeat(starts, size)
    flat[inside] = data[place[inside]]
    return flat, begin, size


def _steps(word: np.ndarray, place: np.ndarray, longest: int):
    """Arcs in the order of a place in their words: the order, and where each place's arcs begin."""
    order = np.lexsort((word, place))
    return order, np.searchsorted(place[order], np.arange(longest + 2))


def _alive(size: np.ndarray, longest: int) -> np.ndarray:
    """How many words (longest first) have at least 0, 1, 2, ... bytes."""
    return len(size) - np.searchsorted(size[::-1], np.arange(longest + 2))


def forward(vocab: Vocabulary, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations; the longest word comes first.

    Only the last ``PIECE_BYTES`` states are held, and they are scaled as the walk goes on, so words
    may be of any length.
    """
    n_words, n_langs, longest = len(size), chances.shape[1], int(size[0])
    word, start, end, piece = vocab.arcs(flat, begin, size)
    order, first = _steps(word, end, longest)
    word, start, piece = word[order], start[order], piece[order]
    alive, ring = _alive(size, longest), PIECE_BYTES + 1
    state = np.zeros((ring, n_words, n_langs))
    state[0] = 1
    scale, out = np.zeros((n_words, n_langs)), np.empty((n_words, n_langs))
    for t in range(1, longest + 1):
        some, n = slice(first[t], first[t + 1]), alive[t]
        w = word[some]
        # a single byte ends at every place of every word, so no word is without an arc
        now = np.add.reduceat(state[start[some] % ring, w] * chances[piece[some]], np.searchsorted(w, np.arange(n)), axis=0)
        if t % 8 == 0:
            scale[:n] += np.log(now)
            state[:, :n] /= now
            now = np.ones_like(now)
        state[t % ring, :n] = now
        done = slice(alive[t + 1], n)
        out[done] = np.log(now[done]) + scale[done]
    return out


def expected(vocab: Vocabulary, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, counts: np.ndarray,
             chances: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur ``counts`` times in each language."""
    n_words, n_langs, longest = len(size), chances.shape[1], int(size[0])
    word, start, end, piece = vocab.arcs(flat, begin, size)
    alive = _alive(size, longest)
    ahead, back = np.zeros((2, longest + 1, n_words, n_langs))
    ahead[0] = 1
    back[size, np.arange(n_words)] = 1
    order, first = _steps(word, end, longest)
    for t in range(1, longest + 1):
        some = order[first[t]:first[t + 1]]
        w = word[some]
        ahead[t, :alive[t]] = np.add.reduceat(ahead[start[some], w] * chances[piece[some]],
                                              np.searchsorted(w, np.arange(alive[t])), axis=0)
    order, first = _steps(word, start, longest)
    for t in range(longest - 1, -1, -1):
        some = order[first[t]:first[t + 1]]
        w = word[some]
        back[t, :alive[t + 1]] = np.add.reduceat(back[end[some], w] * chances[piece[some]],
                                                 np.searchsorted(w, np.arange(alive[t + 1])), axis=0)
    share = counts / back[0]
    out = np.empty(chances.shape)
    for lang in range(n_langs):
        weight = ahead[start, word, lang] * chances[piece, lang] * back[end, word, lang] * share[word, lang]
        out[:, lang] = np.bincount(piece, weight, minlength=len(chances))
    return out


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities of pieces (rows) per language (columns) from their counts."""
    every = counts.sum(1) + EVEN
    every /= every.sum()
    return np.maximum((counts + SHARED * every[:, None]) / (counts.sum(0) + SHARED), LEAST)


@dataclass(frozen=True)
class Model:
    """Languages in order, log-priors, and the probability of each piece (row) in each language (column)."""

    languages: list[str]
    prior: np.ndarray
    chances: np.ndarray
    path: str
    name: str

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probabilities of words, the longest side by side first."""
        out = np.empty((len(starts), len(self.languages)))
        order = np.argsort(starts - ends, kind="stable")
        most = max(1, STATE_CELLS // (len(self.languages) * (PIECE_BYTES + 1)))
        for i in range(0, len(order), most):
            some = order[i:i + most]
            out[some] = forward(vocabulary(self.path), *spell(data, starts[some], ends[some]), self.chances)
        return out


class _Known:
    """Log-probabilities of words met before; a word has two slots, which keep the oldest and the newest."""

    def __init__(self, model: Model):
        self.bits = max(4, int(np.log2(CACHE_CELLS / len(model.languages))) - 1)
        self.keys = np.zeros(2 << self.bits, np.uint64)
        self.values = np.zeros((2 << self.bits, len(model.languages)))

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((keys >> np.uint64(64 - self.bits)).astype(np.int64),
                (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64) + (1 << self.bits))

    def find(self, model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = hash_spans(data, starts, ends)
        keys[keys == 0] = 1
        first, second = self._slots(keys)
        slot = np.where(self.keys[first] == keys, first, second)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, pick, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            values = model.words(data, starts[miss[pick]], ends[miss[pick]])
            out[miss] = values[back]
            first, second = self._slots(new)
            slot = np.where(self.keys[first] == 0, first, second)
            self.keys[slot], self.values[slot] = new, values
        return out


_KNOWN: dict[str, _Known] = {}


def _known(model: Model) -> _Known:
    """The table of a worker's newest model."""
    if model.name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model.name] = _Known(model)
    return _KNOWN[model.name]


def letters_only(text: Column) -> Column:
    """Lowered words of letters and their marks, a space between."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def _expect(words: DataFrame, chances: np.ndarray, path: str) -> np.ndarray:
    """Expected counts of all pieces over the table of words; sums of fixed-point numbers, so order is free."""
    n_langs, unit = chances.shape[1], 1 << 20

    def expect(batches):
        vocab = vocabulary(path)
        sums = np.zeros(chances.shape)
        most = max(1, STATE_CELLS // (2 * n_langs * (LEARN_BYTES + 1)))
        for batch in batches:
            column = batch.column("languages")
            counts = np.zeros((batch.num_rows, n_langs))
            row = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            counts[row, column.flatten().to_numpy(zero_copy_only=False)] = batch.column("counts").flatten().to_numpy(
                zero_copy_only=False)
            for first, end, offsets, data in pieces(batch.column("word")):
                flat, begin, size = spell(data, offsets[:-1], offsets[1:])
                cuts = -(-size // LEARN_BYTES)  # long words are cut
                owner = np.repeat(np.arange(len(size)), cuts)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                at = begin[owner] + nth * LEARN_BYTES
                n = np.minimum(size[owner] - nth * LEARN_BYTES, LEARN_BYTES)
                order = np.argsort(-n, kind="stable")
                for i in range(0, len(order), most):
                    some = order[i:i + most]
                    own = n[some]
                    place = np.cumsum(own) - own
                    spelt = flat[np.arange(own.sum()) - np.repeat(place, own) + np.repeat(at[some], own)]
                    sums += expected(vocab, spelt, place, own, counts[first:end][owner[some]], chances)
        piece, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array(piece, pa.int32()), "language": pa.array(lang, pa.int32()),
            "n": pa.array(np.rint(sums[piece, lang] * unit).astype(np.int64))})

    rows = (words.mapInArrow(expect, "piece int, language int, n long").groupBy("piece", "language")
            .agg(F.sum("n").alias("n")))
    out = np.zeros(chances.shape)
    for r in rows.collect():  # pieces times languages
        out[r.piece, r.language] = r.n / unit
    return out


def train(docs: DataFrame, path: str, text: str = "text", language: str = "lang", key: str = "doc_id",
          sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learn from the rows that have a language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(language).cast("string").alias("lang"), F.col(key).alias("id"),
                       whole_text(text).alias("_text")).where("lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages, vocab = sorted(sizes), vocabulary(path)
    n = np.array([sizes[x] for x in languages], float)
    chances = np.full((len(vocab.pieces), len(languages)), 1 / len(vocab.pieces))
    if languages:
        shares = spark.createDataFrame([(i, x, min(1.0, sample / sizes[x])) for i, x in enumerate(languages)],
                                       "language int, lang string, share double")
        # one row per language
        some = rows.join(F.broadcast(shares), "lang").where(
            F.pmod(F.xxhash64("id", "_text"), F.lit(1 << 32)) < F.col("share") * (1 << 32))
        words = written(some.select("language", F.explode(F.split(letters_only(F.col("_text")), " ")).alias("word"))
                        .where("word <> ''").groupBy("word", "language").count().groupBy("word")
                        .agg(F.collect_list("language").alias("languages"), F.collect_list("count").alias("counts")), "words")
        for _ in range(rounds):
            chances = smoothed(_expect(words, chances, path))
    return Model(languages, np.log((n + 1) / (n.sum() + len(n))), chances, path, uuid.uuid4().hex)


def identify(text: Column, model: Model) -> Column:
    """``struct<language, score>`` of each whole text: the language's number, or -1, and its posterior."""

    @F.arrow_udf("struct<language: int, score: double>")
    def found(texts: pa.Array) -> pa.Array:
        best, score = np.full(len(texts), -1, np.int32), np.zeros(len(texts))
        for first, end, offsets, data in pieces(texts, TEXT_BYTES):
            starts, ends = word_spans(offsets, data)
            if not (len(starts) and model.languages):
                continue
            each = _known(model).find(model, data, starts, ends)
            owner = np.searchsorted(offsets, starts, "right") - 1
            total = np.stack([np.bincount(owner, column, minlength=end - first) for column in each.T], 1) + model.prior
            total -= total.max(1, keepdims=True)
            chance = 1 / np.exp(total).sum(1)
            some = np.bincount(owner, minlength=end - first) > 0
            best[first:end][some] = total.argmax(1)[some]
            score[first:end][some] = chance[some]
        return pa.StructArray.from_arrays([pa.array(best), pa.array(score)], ["language", "score"])

    return found(text)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of those names."""
    names = F.array(*[F.lit(x) for x in model.languages]) if model.languages else F.array(F.lit(UNDETERMINED))
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    said = F.when(has_letter, letters_only(whole_text(text))).otherwise(F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*kept).alias("_row"), identify(said, model).alias("_said"))
    number = F.col("_said.language")
    return rows.select("_row.*", F.when(number >= 0, F.get(names, number)).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
                       F.col("_said.score").alias("score"))
