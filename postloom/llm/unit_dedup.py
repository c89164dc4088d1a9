"""Deduplication of repeated passages by hashing lines and the sentences in them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.llm.scratch import Scratch
from postloom.llm.wordhash import combine, flat, hash_slices, mix, row_words, slices, word_bounds

#: A run of repeated units is removed where it has at least so many words.
MIN_WORDS = 20
#: Words of units below this length do not count towards that: stock phrases, headings, shouted words.
UNIT_WORDS = 4

_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_LETTER = np.ones(256, bool)
_LETTER[[i for i in range(128) if not chr(i).isalnum()]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def unit_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """First words of the units: after a row's start, a line break, or a word that ends in . ! or ?"""
    first = np.zeros(len(starts), bool)
    first[rows[:-1][rows[:-1] < len(starts)]] = True
    breaks = np.r_[0, np.cumsum(data == 10)]
    first[1:] |= breaks[starts[1:]] > breaks[ends[:-1]]
    first[1:] |= _END[data[ends[:-1] - 1]]
    return np.flatnonzero(first)


def unit_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each unit's normalised words, and how many of its words have letters or digits.

    Normal form: A-Z lower-cased, ASCII signs at both ends of words ignored, blanks ignored.
    """
    left, right = starts.copy(), ends.copy()
    for edge, step in ((left, 1), (right, -1)):
        move = np.arange(len(left))
        while len(move):
            at = edge[move] - (step < 0)
            move = move[(left[move] < right[move]) & ~_LETTER[data[np.minimum(at, len(data) - 1)]]]
            edge[move] += step
    real = left < right
    number = np.cumsum(real) - 1
    words = hash_slices(data, left[real], right[real], lower=True)
    counts = np.add.reduceat(real.astype(np.int64), firsts) if len(firsts) else np.zeros(0, np.int64)
    at = number[firsts] + (~real[firsts])
    out = np.zeros(len(firsts), np.uint64)
    # Units of equal length are hashed together.
    for n in np.unique(counts):
        which = np.flatnonzero(counts == n)
        if n == 0:
            continue
        if n <= 200:
            picked = words[at[which][:, None] + np.arange(n)[None, :]]
            total = np.zeros(len(which), np.uint64)
            for i in range(n):
                total = (total + picked[:, i] + np.uint64(i + 1)) * np.uint64(0x9FB21C651E98DF25)
                total ^= total >> np.uint64(29)
            out[which] = total
        else:
            for w in which:
                out[w] = combine(words[at[w]:at[w] + n], int(n))[0]
    return out, counts


def _units(part: pa.Array):
    """(row of each unit, start byte, end byte, hash, words) of a column of texts, and its bytes."""
    data, offsets = flat(part)
    starts, ends = word_bounds(data, offsets)
    if not len(starts):
        return data, offsets, *[np.zeros(0, np.int64)] * 5
    rows = row_words(offsets, starts)
    firsts = unit_bounds(data, starts, ends, rows)
    hashes, words = unit_hashes(data, starts, ends, firsts)
    last = np.r_[firsts[1:], len(starts)] - 1
    return data, offsets, np.searchsorted(offsets, starts[firsts], "right") - 1, starts[firsts], ends[last], hashes, words


def unit_lines(data: np.ndarray, row: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The number of each unit's line, over all rows."""
    breaks = np.r_[0, np.cumsum(data == 10)]
    return np.cumsum(np.r_[True, (row[1:] != row[:-1]) | (breaks[begin[1:]] > breaks[begin[:-1]])]) - 1 if len(row) else np.zeros(0, np.int64)


def _line_hashes(line: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines with several units: place of the first unit, and a hash of the units in their order."""
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(line)])
    at = np.arange(len(line)) - np.repeat(first, counts)
    placed = mix(hashes + mix((at + 1).astype(np.uint64)))
    total = np.add.reduceat(placed, first) if len(first) else placed
    several = counts > 1
    return first[several], mix(total[several] + counts[several].astype(np.uint64))


def _emit(whole_lines: bool) -> Callable:
    """Digests of units and, with a negative number, of lines that have several units."""
    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column("_text")):
                part = batch.slice(start, len(texts))
                data, _, row, begin, _, hashes, words = _units(texts)
                if len(row):
                    number = np.arange(len(row)) - np.searchsorted(row, row, "left")
                    keep = words > 0
                    line = unit_lines(data, row, begin)[keep]
                    row, number, hashes = row[keep], number[keep], hashes[keep]
                    if whole_lines:
                        first, more = _line_hashes(line, hashes)
                        row, number, hashes = np.r_[row, row[first]], np.r_[number, -1 - number[first]], np.r_[hashes, more]
                    keys = part.column("_key").take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), keys, pa.array(number.astype(np.int32))], ["digest", "key", "unit"])
    return run


def _whole(seen: dict, line: np.ndarray, words: np.ndarray) -> set[int]:
    """The units of one text whose whole line is a repeat; ``seen`` has a repeated line as -1 - its first unit with words."""
    out: set[int] = set()
    edges = np.flatnonzero(np.r_[True, line[1:] != line[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        real = [u for u in range(a, b) if words[u]]
        if real and (real[0] in seen if len(real) == 1 else -1 - real[0] in seen):
            out.update(real)
    return out


def _cut(min_words: int, whole_lines: bool) -> Callable:
    """Remove runs of repeated units from each text; keep the original place of what stays and goes."""
    def run(batches):
        for batch in batches:
            for low_row, text in slices(batch.column("_text")):
                part = batch.slice(low_row, len(text))
                data, offsets, row, begin, end, _, words = _units(text)
                repeats, rest = part.column("_repeats").to_pylist(), [n for n in part.schema.names if n not in ("_text", "_repeats")]
                rows = np.searchsorted(row, np.arange(part.num_rows + 1))
                line = unit_lines(data, row, begin)
                texts, removed = [], []
                for i in range(part.num_rows):
                    spans = []
                    if repeats[i]:
                        low = rows[i]
                        seen = {r["unit"]: r for r in repeats[i]}
                        whole = _whole(seen, line[low:rows[i + 1]], words[low:rows[i + 1]]) if whole_lines else set()
                        run_of: list = []
                        for u in range(rows[i + 1] - low + 1):
                            if u in seen:
                                run_of.append(u)
                                continue
                            # Units without any word neither break nor make a run.
                            if u < rows[i + 1] - low and words[low + u] == 0 and run_of:
                                continue
                            if sum(words[low + x] for x in run_of if words[low + x] >= UNIT_WORDS) >= min_words:
                                goes = [run_of]
                            else:
                                goes = [list(g) for stays, g in groupby(run_of, lambda x: x not in whole) if not stays]
                            spans += [(int(begin[low + g[0]]), int(end[low + g[-1]]), seen[g[0]]) for g in goes if g]
                            run_of = []
                    base, stop = int(offsets[i]), int(offsets[i + 1])
                    raw, at, head, kept, out = data[base:stop].tobytes(), 0, 0, [], []
                    for a, b, first in spans:
                        kept.append(raw[at:a - base])
                        start = head + len(kept[-1].decode("utf-8"))
                        head = start + len(raw[a - base:b - base].decode("utf-8"))
                        out.append({"start": start, "end": head, "kept_key": first["first"]["key"], "kept_unit": first["first"]["unit"]})
                        at = b - base
                    kept.append(raw[at:])
                    removed.append(out)
                    texts.append((b"".join(kept).decode("utf-8") if spans else text[i].as_py()))
                key_type = part.schema.field("_kept").type
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept_key", key_type), ("kept_unit", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in rest if n != "_kept"], pa.array(texts, pa.string()), pa.array(removed, kind)],
                    [*[n for n in rest if n != "_kept"], "_text", "removed"],
                )
    return run


def dedup_units(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, whole_lines: bool = False) -> DataFrame:
    """Every row of ``df``, its text without passages that an earlier text or place has, and ``removed``.

    Units are lines, and in them sentences (up to a word that ends in . ! or ?), so that a passage
    is found inside a longer line, too.  A unit is normalised (A-Z lower-cased, signs around words
    and blanks ignored) and hashed to 64 bits; globally the first unit of a digest, by key and then
    place in the text, is the one that is kept.  A run of neighbouring later units is removed where
    it has at least ``min_words`` words in units of UNIT_WORDS and more; shorter repeats (headings, stock phrases) stay.

    With ``whole_lines`` that floor holds only for pieces of lines.  A whole line goes, however short,
    where an earlier place has it: as its only unit, or, with several units, as a line of the same
    units (lines of several units have a digest of their own).  So does a paragraph, line by line.

    ``removed``
    lists start and end of each run in code points of the original text with the key and unit
    number of the first unit's kept occurrence, so the original can be put together again.

    Digests move, not texts; a common digest folds in the tasks before it moves and its repeats
    are spread by the join.  Only the list of repeats of a text meets the text again.

    A null text stays null; an empty one stays.  Rows with a null key are kept as they are.  Rows
    that repeat a key count as one place, so copies of one row stay.  An empty table gives an empty
    result.  An input column named removed is replaced.
    """
    scratch = Scratch(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    units = scratch.keep(docs.mapInArrow(_emit(whole_lines), f"digest long, key {key_type}, unit int"))
    # Written, so that both sides of the join are plain exchanges and a common digest's rows can be split.
    # A line with several units has a negative number; its place is that of its first unit.
    place = F.when(F.col("unit") < 0, -1 - F.col("unit")).otherwise(F.col("unit")).alias("place")
    earliest = F.min(F.struct("key", place, "unit"))
    firsts = units.groupBy("digest").agg(earliest.alias("_first"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.keep(firsts.select("digest", F.struct("_first.key", "_first.unit").alias("first")))
    later = units.join(firsts, "digest").where((F.col("key") != F.col("first.key")) | (F.col("unit") != F.col("first.unit")))
    repeats = scratch.keep(later.groupBy("key").agg(F.collect_set(F.struct("unit", "first")).alias("_repeats")))
    scratch.drop(units, firsts)

    kept = [c for c in df.columns if c not in (text, "removed")]
    work = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text"), F.col(key).alias("_kept"))
    work = work.join(repeats.withColumnRenamed("key", "_k"), F.col("_kept") == F.col("_k"), "left").select(*[F.col(f"`{c}`") for c in kept], "_text", "_kept", "_repeats")
    added = StructType.fromDDL(f"_text string, removed array<struct<start:int,end:int,kept_key:{key_type},kept_unit:int>>")
    schema = StructType([*work.drop("_text", "_kept", "_repeats").schema.fields, *added.fields])
    out = work.mapInArrow(_cut(min_words, whole_lines), schema)
    return out.select(*[F.col("_text").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c != "removed"], "removed")
