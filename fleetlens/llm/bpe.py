"""Byte-level BPE: encoding and decoding with a public vocabulary file.

Texts are cut by the vocabulary's word pattern.  A word holds its part boundaries and the ranks of
adjacent parts side by side in two short arrays; the smallest rank is found by a scan, its boundary
is deleted and the two neighbouring ranks are looked up again, until no pair has a rank.  Words of
more than ``LONG_WORD`` bytes, where scans would grow with the square, take the same merges from a
heap.  Short words that are new in a batch are merged side by side, a row for each.  Runs (a word with
the space before it, or white space) are found on the bytes of a batch and named by a 64-bit hash; ids
of runs that were seen before come from tables of bounded size.  Texts that hold a special token's string or
white space beyond ASCII are cut by a pattern instead, with the same ids.

Both functions are column expressions, so they keep all other columns and never shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.llm.text import hash_spans, pieces

LONG_WORD = 256
CACHE_WORDS = 150_000
CACHE_BITS, CACHE_IDS = 19, 1 << 21
PIECE_BYTES = 1 << 18
BLOCK_WIDTHS, BLOCK_ROWS = (8, 16, 32), 8192
# letters below this one have been letters since the first versions of Unicode
_PLAIN_END = "\u0250"
# marks a special token among runs; no run of a text starts with it followed by such a token
_SPECIAL = "\ud800"
ID_BITS = 20
_ID = (1 << ID_BITS) - 1
_NONE = 1 << 62

# The word pattern of the vocabulary, and Unicode's white space
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        shown = byte_letters()
        byte_of = {c: b for b, c in shown.items()}
        vocab = model["vocab"]
        self.first = [vocab[shown[b]] for b in range(256)]
        # rank and id of the merged part in one number, so that the smallest rank is the smallest number
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[left], vocab[right]), rank << ID_BITS | vocab[left + right])
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t)
                            else t.encode() for t, i in vocab.items()}
        self.token_bytes |= {i: t.encode() for t, i in self.specials.items()}
        # white space is spelt out: the two pattern libraries do not agree on what \s holds
        words = WORD_PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]") \
                            .replace(r"\S", f"[^{WHITE}]")
        self.words = regex.compile(words)
        self.runs = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        letters = "".join(c for c in map(chr, range(ord(_PLAIN_END))) if c.isalpha())
        self.plain = re.compile(f" ?[{letters}]+")
        names = sorted(self.specials, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        pairs = sorted((left << ID_BITS | right, best) for (left, right), best in self.ranks.items())
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs))
        self.first_ids = np.array(self.first, np.int64)
        self.known_words: dict[str, bytes] = {}
        white = [c for c in map(chr, range(1 << 16)) if re.match(f"[{WHITE}]", c)]  # WHITE holds ranges
        self.white = np.zeros(256, bool)
        self.white[[ord(c) for c in white if c < "\x80"]] = True
        # white space beyond ASCII, and the strings of special tokens
        self.odd = [*(c.encode() for c in white if c >= "\x80"), *(t.encode() for t in self.specials)]
        # a run's hash, and the place and number of its ids in the pool.  A run has two slots; the first keeps
        # its oldest run, as frequent runs come early, and the second its newest
        self.run_keys = np.zeros(2 << CACHE_BITS, np.uint64)
        self.run_at = np.zeros(2 << CACHE_BITS, np.int64)
        self.run_size = np.zeros(2 << CACHE_BITS, np.int32)
        self.pool, self.pooled = np.empty(1 << 16, np.int32), 0
        every = range(max(self.token_bytes) + 1)
        self.spelt = pa.array([self.token_bytes.get(i, b"") for i in every] + [b""], pa.large_binary())

    def merge(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        look = self.ranks.get
        pairs = [look(p, _NONE) for p in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != _NONE:
            at = pairs.index(best)
            parts[at:at + 2] = [best & _ID]
            del pairs[at]
            if at:
                pairs[at - 1] = look((parts[at - 1], parts[at]), _NONE)
            if at < len(pairs):
                pairs[at] = look((parts[at], parts[at + 1]), _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, from a heap of (rank, place, left, right)."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            best, at, left, right = heapq.heappop(heap)
            nxt = after[at]
            if parts[at] != left or nxt >= len(parts) or parts[nxt] != right:
                continue
            parts[at], parts[nxt] = best & _ID, -1
            after[at] = after[nxt]
            if after[at] < len(parts):
                before[after[at]] = at
            for i in (before[at], at):
                if i >= 0 and after[i] < len(parts):
                    pair = parts[i], parts[after[i]]
                    if pair in self.ranks:
                        heapq.heappush(heap, (self.ranks[pair], i, *pair))
        return [p for p in parts if p >= 0]

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed ranks of pairs of parts; -1 stands for no part."""
        keys = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)

    def _merge_block(self, words: list[bytes], width: int) -> list[bytes]:
        """``merge`` of many short words side by side: a row of parts and a row of ranks for each."""
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        parts = np.where(np.arange(width) < size[:, None], self.first_ids[raw], -1)
        ranks = np.full((len(words), width), _NONE)
        ranks[:, :-1] = self._look(parts[:, :-1], parts[:, 1:])
        rows, places = np.arange(len(words)), np.arange(width)
        while len(rows):
            here = ranks[rows]
            at = here.argmin(1)
            best = here[np.arange(len(rows)), at]
            rows, at, best = (x[best != _NONE] for x in (rows, at, best))
            if not len(rows):
                break
            parts[rows, at] = best & _ID
            moved = np.minimum(places + (places > at[:, None]), width - 1)
            p, r = (np.take_along_axis(x[rows], moved, 1) for x in (parts, ranks))
            p[:, -1], r[:, -1] = -1, _NONE
            r[np.arange(len(rows)), at] = _NONE
            n = np.arange(len(rows))
            # the boundary after ``at`` is gone: rank of (at, at + 1) and of (at - 1, at) anew
            r[n, at] = self._look(p[n, at], p[n, np.minimum(at + 1, width - 1)])
            left = at > 0
            r[n[left], at[left] - 1] = self._look(p[n[left], at[left] - 1], p[n[left], at[left]])
            parts[rows], ranks[rows] = p, r
            size[rows] -= 1
        flat = parts[places < size[:, None]].astype("<i4").tobytes()
        ends = np.cumsum(size) * 4
        return [flat[e - 4 * n:e] for e, n in zip(ends.tolist(), size.tolist())]

    def _learn_words(self, words: set[str]) -> None:
        if len(self.known_words) + len(words) > CACHE_WORDS:
            self.known_words.clear()
        by_width: dict[int, list[str]] = {}
        for word in words.difference(self.known_words):
            n = len(word.encode())
            by_width.setdefault(next((w for w in BLOCK_WIDTHS if n <= w), 0), []).append(word)
        for width, group in by_width.items():
            if not width:
                for word in group:
                    ids = self.merge(word.encode())
                    self.known_words[word] = struct.pack(f"<{len(ids)}i", *ids)
                continue
            for i in range(0, len(group), BLOCK_ROWS):
                some = group[i:i + BLOCK_ROWS]
                self.known_words.update(zip(some, self._merge_block([w.encode() for w in some], width)))

    def _words_of(self, run: str) -> list[str]:
        """The pattern's words in a run; plain words with at most one mark behind need no pattern."""
        if self.plain.fullmatch(run):
            return [run]
        if run[-1] in ",.;:!?" and self.plain.fullmatch(run, 0, len(run) - 1):
            return [run[:-1], run[-1]]
        return self.words.findall(run)

    def _ids_of(self, runs: list[str]) -> list[bytes]:
        """Ids of each run as little-endian int32."""
        words = [self._words_of(run) for run in runs]
        self._learn_words({w for some in words for w in some})
        known = self.known_words.__getitem__
        return [b"".join(map(known, some)) for some in words]

    def _cut(self, text: str) -> list[str]:
        """Runs of the text; a special token's string stays whole."""
        if self.split is None or not any(s in text for s in self.specials):
            return self.runs.findall(text)
        out = []
        for part in self.split.split(text):
            out += [_SPECIAL + part] if part in self.specials else self.runs.findall(part)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32; strings of special tokens become their ids."""
        cut = [self._cut(t) for t in texts]
        runs = set().union(*cut)
        known = {r: struct.pack("<i", self.specials[r[1:]]) for r in runs
                 if r[0] == _SPECIAL and r[1:] in self.specials}
        rest = list(runs.difference(known))
        known.update(zip(rest, self._ids_of(rest)))
        return [b"".join([known[r] for r in c]) for c in cut]

    def _run_starts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """First byte of every run: of a text, of a word or the space before it, of white space."""
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        white = self.white[data]
        begins, ends = edge[:-1], edge[1:]
        old_white, old_space, next_letter = (np.zeros(len(data), bool) for _ in range(3))
        old_white[1:], old_space[1:], next_letter[:-1] = white[:-1], data[:-1] == 0x20, ~white[1:]
        word = ~white & old_white & ~old_space
        # a word takes the space before it; other white space before a word is a run of its own
        space = white & (~old_white | (next_letter & ~ends))
        return np.flatnonzero(begins | word | space)

    def _odd_texts(self, offsets: np.ndarray, raw: bytes) -> np.ndarray:
        odd = np.zeros(len(offsets) - 1, bool)
        for sign in self.odd:
            at = raw.find(sign)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                odd[text] = True
                at = raw.find(sign, int(offsets[text + 1]))
        return odd

    def _keep(self, ids: np.ndarray) -> int:
        """Place in the pool of these ids, which are added to it."""
        at, self.pooled = self.pooled, self.pooled + len(ids)
        if self.pooled > len(self.pool):
            grown = np.empty(max(self.pooled, 2 * len(self.pool)), np.int32)
            grown[:at] = self.pool[:at]
            self.pool = grown
        self.pool[at:self.pooled] = ids
        return at

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = (keys >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        return first, (keys & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int64) + (1 << CACHE_BITS)

    def _encode_piece(self, offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a piece of a column."""
        if self.pooled > CACHE_IDS:
            self.pooled = 0
            self.run_keys[:] = 0
        raw = data.tobytes()
        odd = self._odd_texts(offsets, raw)
        starts = self._run_starts(offsets, data)
        ends = np.append(starts[1:], len(data))
        if odd.any():
            plain = ~odd[np.searchsorted(offsets, starts, "right") - 1]
            starts, ends = starts[plain], ends[plain]
        keys = hash_spans(data, starts, ends)
        keys[keys == 0] = 1
        first, second = self._slots(keys)
        slot = np.where(self.run_keys[first] == keys, first, second)
        at, size = self.run_at[slot], self.run_size[slot].astype(np.int64)
        miss = np.flatnonzero(self.run_keys[slot] != keys)
        if len(miss):
            new, pick, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            spans = zip(starts[miss[pick]].tolist(), ends[miss[pick]].tolist())
            ids = self._ids_of([raw[a:b].decode() for a, b in spans])
            sizes = np.array([len(i) // 4 for i in ids], np.int64)
            begin = self._keep(np.frombuffer(b"".join(ids), "<i4")) + np.cumsum(sizes) - sizes
            at[miss], size[miss] = begin[back], sizes[back]
            first, second = self._slots(new)
            slot = np.where(self.run_keys[first] == 0, first, second)
            self.run_keys[slot], self.run_at[slot], self.run_size[slot] = new, begin, sizes
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - until[:-1], size) + np.arange(until[-1])]
        each = np.split(ids, until[np.searchsorted(starts, offsets[1:-1])])
        for i in np.flatnonzero(odd).tolist():
            text = raw[offsets[i]:offsets[i + 1]].decode()
            each[i] = np.frombuffer(self.encode_all([text])[0], "<i4")
        return each

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null is the empty text."""
        each = [ids for _, _, offsets, data in pieces(texts, PIECE_BYTES)
                for ids in self._encode_piece(offsets, data)]
        ends = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int32)
        flat = np.concatenate(each) if each else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))

    def decode_column(self, arrays: pa.ListArray) -> pa.Array:
        """The text of each array of ids; null gives the empty text.

        Bytes that are no UTF-8 become U+FFFD; unknown and null ids give nothing.
        """
        if isinstance(arrays, pa.ChunkedArray):
            arrays = arrays.combine_chunks()
        none = len(self.spelt) - 1
        ids = arrays.flatten().cast(pa.int64()).fill_null(none).to_numpy()
        tokens = self.spelt.take(pa.array(np.where((ids >= 0) & (ids < none), ids, none)))
        size = arrays.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        places = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1)
        ends = places[np.concatenate([[0], np.cumsum(size)])]
        data = tokens.buffers()[2] or pa.py_buffer(b"")
        out = pa.LargeStringArray.from_buffers(len(arrays), pa.py_buffer(ends.tobytes()), data)
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.to_pybytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.large_string())
        return out.cast(pa.string())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(text: Column, path: str) -> Column:
    """``array<int>`` of ids of each whole text; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        return tokenizer(path).encode_column(texts)

    return ids_of(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of ids; null gives the empty text."""

    @F.arrow_udf("string")
    def text_of(arrays: pa.Array) -> pa.Array:
        return tokenizer(path).decode_column(arrays)

    return text_of(ids)
