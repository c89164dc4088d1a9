"""Word and shingle hashes of whole Arrow string columns, for use inside tasks.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z where asked.
Words get 64-bit hashes from one pass over the column's bytes: a prefix sum of byte values times
powers of an odd base gives every word's polynomial, which a finaliser mixes.  Buffers are worked
in pieces of a few MB cut between words, so memory follows the piece and the words, not the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes hashed at once, and bytes of texts whose words are held at once.
PIECE, SLICE = 1 << 18, 1 << 21

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values go far apart."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 4096), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end byte of every word; a word never reaches over a row's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the byte slices [start, end), which are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        piece = data[base:ends[upto - 1]]
        if lower:
            piece = _LOWER[piece]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(piece)), out=sums[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        value = (sums[e] - sums[s]) * _power(_BASE_INVERSE, len(piece) + 1)[s]
        out[at:upto] = mix(value + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        at = upto
    return out


def row_words(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each row's words begin among all words; the last entry is their number."""
    return np.searchsorted(starts, offsets, "left")


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of every run of n consecutive values."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total += hashes[i:len(hashes) - n + 1 + i] * _STEP[i % 64]
    return mix(total + np.uint64(n))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """First row and column part, of about ``limit`` bytes each or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield at, column.slice(at, upto - at)
        at = upto


def shingle_lists(column: pa.Array, n: int = SHINGLE, shorter: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and all its shingle hashes in text order (repeats kept), for every row.

    A text of fewer than n words has one shingle, the whole sequence; one without words has none.
    Runs of each length in ``shorter`` (below n) follow the shingles.
    """
    for first, part in slices(column):
        data, offsets = flat(part)
        starts, ends = word_bounds(data, offsets)
        words = hash_slices(data, starts, ends, lower=True)
        rows = row_words(offsets, starts)
        runs = combine(words, n)
        more = [(m, combine(words, m)) for m in shorter]
        for i in range(len(offsets) - 1):
            low, high = rows[i], rows[i + 1]
            if high - low >= n:
                found = runs[low:high - n + 1]
            elif high > low:
                found = combine(words[low:high], int(high - low))
            else:
                found = runs[:0]
            if more:
                found = np.concatenate([found, *[x[low:high - m + 1] for m, x in more if high - low >= m]])
            yield first + i, found
