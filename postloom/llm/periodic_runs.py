"""Maximal periodic runs of words in whole texts, and texts with the repetitions taken out.

A run is a stretch of consecutive words with a smallest period q that no neighbouring word extends
and that is at least ``EXPONENT`` periods and ``SHORTEST`` words long.  Every word of a run occurs in
each of its periods, so a word that occurs less than ``EXPONENT`` times in a segment is in none of the
segment's runs and splits it.  The parts are counted anew until nothing splits any more; parts that
are too short go.  All texts of a slice are split together, and only parts that changed are counted
again.

What is left is scanned lag by lag.  A run of period q holds three whole blocks of q words that begin
at multiples of q, and these are equal; so a lag costs one comparison of hashes per block, m / q for a
segment of m words and m log m for all its lags.  Where two neighbouring pairs of blocks agree, the
words themselves are compared: hashes decide nothing but where to look.  Stretches inside a run of a
smaller period have that period and are not looked at.

Words are 64-bit hashes (see ``wordhash``), so "identical" is up to their collisions in one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from postloom.llm.wordhash import flat, hash_slices, mix, row_words, slices, word_bounds

EXPONENT, SHORTEST = 4, 6
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
FOUND = StructType([StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
_BASE = 0x9E3779B97F4A7C15


def frequent_segments(codes: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """First and end place of every segment that no rare word splits any more.

    ``codes`` number the words of many texts from 0; ``group`` is the text of each and never falls.
    """
    kinds = int(codes.max(initial=0)) + 1
    places, stable = np.arange(len(codes)), []
    while len(places):
        cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (places[1:] != places[:-1] + 1)])
        sizes = np.diff(np.r_[cut, len(places)])
        long_enough = np.repeat(sizes >= SHORTEST, sizes)
        segment = np.repeat(np.arange(len(cut)), sizes)[long_enough]
        places = places[long_enough]
        if not len(places):
            break
        pair = segment * kinds + codes[places]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        times = np.diff(np.r_[first, len(ranked)])
        rare = np.empty(len(places), bool)
        rare[order] = np.repeat(times < EXPONENT, times)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        ends = np.r_[starts[1:], len(segment)]
        split = np.add.reduceat(rare, starts) > 0
        stable += [(int(places[a]), int(places[b - 1]) + 1) for a, b in zip(starts[~split], ends[~split])]
        left = np.repeat(split, ends - starts) & ~rare
        places, group = places[left], segment[left]
    return sorted(stable)


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of every stretch of true values."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
    return edges[::2], edges[1::2]


class _Runs:
    """Runs found so far, by start, with the farthest end of all that start no later."""

    def __init__(self):
        self.found: list[tuple[int, int, int]] = []
        self.starts = self.reach = np.zeros(0, np.int64)

    def hold(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of these stretches lie inside one run."""
        if not len(self.starts):
            return np.zeros(len(starts), bool)
        at = np.searchsorted(self.starts, starts, "right") - 1
        return (at >= 0) & (self.reach[at] >= ends)

    def add(self, runs: list[tuple[int, int, int]]) -> None:
        self.found += runs
        spans = np.array(sorted((s, s + n) for s, n, _ in self.found), np.int64)
        self.starts, self.reach = spans[:, 0], np.maximum.accumulate(spans[:, 1])


def scan_lags(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment, by rising period."""
    n, runs = len(codes), _Runs()
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)]
    for q in range(1, n // EXPONENT + 1):
        blocks = np.diff(sums[::q])
        same = blocks[:-1] * powers[q] == blocks[1:]
        both = same[:-1] & same[1:]
        if not both.any():
            continue
        first, last = _stretches(both)
        first, last = first * q, (last + 2) * q
        new = ~runs.hold(first, last)
        found = []
        for a, b in zip(first[new].tolist(), last[new].tolist()):
            low, high = max(0, a - q), min(n, b + q)
            window = codes[low:high]
            for s, e in zip(*(x.tolist() for x in _stretches(window[:-q] == window[q:]))):
                if e - s + q >= max(SHORTEST, EXPONENT * q):
                    found.append((low + s, e - s + q, q))
        if found:
            spans = np.array(found, np.int64)
            held = runs.hold(spans[:, 0], spans[:, 0] + spans[:, 1])
            found = sorted({r for r, old in zip(found, held.tolist()) if not old})
        if found:
            runs.add(found)
            if any(length == n for _, length, _ in found):
                break  # any other run would lie inside and have this period
    return runs.found


def _runs_of_texts(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start among all words, length, period) by start and period, and which words repeat."""
    _, codes = np.unique(words, return_inverse=True)
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    found = [(a + s, n, q) for a, b in frequent_segments(codes, text) for s, n, q in scan_lags(codes[a:b])]
    runs = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return runs, np.cumsum(step[:-1]) > 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row joined by one blank, as bytes and offsets."""
    sizes = ends - starts + 1
    last = rows[1:][np.diff(rows) > 0] - 1
    sizes[last] -= 1
    out_at = np.r_[0, np.cumsum(sizes)]
    take = np.arange(out_at[-1]) + np.repeat(starts - out_at[:-1], sizes)
    out = np.r_[data, np.uint8(0x20)][take]
    blank = out_at[1:] - 1
    inner = np.ones(len(sizes), bool)
    inner[last] = False
    out[blank[inner]] = 0x20
    return out, out_at[rows]


def collapse(texts: pa.Array) -> pa.Array:
    """Runs and collapsed text of every row of a string column."""
    all_runs, run_counts, parts = [], [], []
    for _, part in slices(texts):
        data, offsets = flat(part)
        starts, ends = word_bounds(data, offsets)
        rows = row_words(offsets, starts)
        runs, repeats = _runs_of_texts(hash_slices(data, starts, ends), rows)
        row = np.searchsorted(rows, runs[:, 0], "right") - 1
        run_counts.append(np.bincount(row, minlength=len(part)))
        all_runs.append(np.column_stack([runs[:, 0] - rows[row], runs[:, 1:]]))
        kept = np.r_[0, np.cumsum(~repeats)]
        out, at = _joined(data, starts[~repeats], ends[~repeats], kept[rows])
        parts.append(pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)).cast(pa.string()))
    runs = np.concatenate(all_runs) if all_runs else np.zeros((0, 3), np.int64)
    counts = np.concatenate(run_counts) if run_counts else np.zeros(0, np.int64)
    fields = [pa.array(np.ascontiguousarray(runs[:, i])) for i in range(3)]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.StructArray.from_arrays(fields, RUN.names))
    return pa.StructArray.from_arrays([lists, pa.concat_arrays(parts) if parts else pa.array([], pa.string())], FOUND.names)


def find_periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in words from 0; by start, then period) and ``collapsed``.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]``.  ``collapsed`` holds the words joined by one
    blank but for those that any run has after its first period.  A text without words, or a null one, has no
    runs and an empty ``collapsed``.  All other columns and all rows stay as they are, null keys and
    repeated rows included; columns called ``runs`` or ``collapsed`` are replaced.  Nothing is shuffled,
    only the text travels, and about 2 MB of texts (or one longer text) are worked at a time.
    """
    found = F.arrow_udf(FOUND)(collapse)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in FOUND.names]
    return docs.select(*kept, found(F.col(f"`{text}`")).alias("_found")).select(*kept, "_found.runs", "_found.collapsed")
