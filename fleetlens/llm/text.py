"""Words of whole texts as 64-bit hashes, computed on the byte buffers of Arrow columns.

A word is a run of bytes other than space and the five controls 0x09-0x0D, so UTF-8 letters never
break.  Words are hashed by a polynomial over their bytes modulo 2**64 followed by a mixing step;
with 10**7 different words the chance of any collision is below 10**-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: bytes of texts whose words are held at once; a worker's memory follows it
PIECE_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n``."""
    inverse = pow(_BASE, -1, 2**64)
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate(
            [np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of runs of rows of about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, spots, data = column.buffers()
    offsets = np.frombuffer(spots, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(max(end, first + 1), len(column))
        lo, hi = offsets[first], offsets[end]
        yield first, end, offsets[first:end + 1] - lo, data[lo:hi]
        first = end


def word_spans(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word; bytes marked in ``space`` and a text's end end a word."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    letter = ~space[data]
    gap = np.concatenate([[True], ~letter])
    starts = np.flatnonzero(letter & (gap[:-1] | edge[:-1]))
    ends = np.flatnonzero(letter & (np.concatenate([~letter[1:], [True]])[:len(data)] | edge[1:])) + 1
    return starts, ends


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64),
                                np.cumsum(_letters()[data] * power[:len(data)], dtype=np.uint64)])
        raw = (total[ends] - total[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # a long text is hashed in runs of spans, so memory stays bounded
        until = max(int(np.searchsorted(ends, starts[done] + 2 * PIECE_BYTES, "right")), done + 1)
        lo, hi = starts[done], ends[until - 1]
        out[done:until] = _hash_spans(data[lo:hi], starts[done:until] - lo, ends[done:until] - lo)
        done = until
    return out


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE
                ) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, index of the first word of each text plus the total)."""
    if lower:
        data = _LOWER[data]
    starts, ends = word_spans(offsets, data, space)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def windows(words: np.ndarray, first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside texts, and the index of each text's first window."""
    counts = np.diff(first_word)
    room = max(len(words) - n + 1, 0)
    with np.errstate(over="ignore"):
        value = np.full(room, n, np.uint64)
        for i in range(n):
            value = mix(value * _U(0x9FB21C651E98DF25) + words[i:i + room])
    keep = np.zeros(len(words) + 1, np.int32)
    long_enough = counts >= n
    np.add.at(keep, first_word[:-1][long_enough], 1)
    np.add.at(keep, (first_word[1:] - n + 1)[long_enough], -1)
    inside = np.cumsum(keep[:-1])[:room] > 0
    each = np.maximum(counts - n + 1, 0)
    return value[inside], np.concatenate([[0], np.cumsum(each)])
