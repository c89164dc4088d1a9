"""Quality rules: counts of whole texts, and hashed n-gram likelihood ratios of target and corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.llm.wordhash import combine, flat, hash_slices, row_words, word_bounds

#: Hash buckets of the two multinomials, whatever the corpus.
BUCKETS = 1 << 16
#: Added to every bucket's count, in the target by the corpus's share: rare buckets weigh little.
SMOOTH = 1.0
#: A text is kept where its log-likelihood ratio per n-gram reaches this many nats.
THRESHOLD = -0.1
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    grams = np.concatenate([words, combine(words, 2)]) if len(words) > 1 else words
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64)


def _repeated_words(words: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    windows = combine(words, WINDOW)
    if len(windows) < 2:
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def _duplicate_lines(data: np.ndarray, starts: np.ndarray, low: int, high: int) -> int:
    """Lines with a word that equal an earlier line of the text data[low:high]."""
    breaks = np.flatnonzero(data[low:high] == 10) + low
    begin, end = np.r_[low, breaks + 1], np.r_[breaks, high]
    filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    lines = hash_slices(data, begin[filled], end[filled])
    return len(lines) - len(np.unique(lines))


def _texts(part: pa.Array):
    """Row, bytes, word hashes and bounds of each text of a column."""
    data, offsets = flat(part)
    starts, ends = word_bounds(data, offsets)
    words, rows = hash_slices(data, starts, ends), row_words(offsets, starts)
    return data, offsets, starts, ends, words, rows


def _gram_counts(batches):
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            _, _, _, _, words, rows = _texts(part.column("_text"))
            trusted = part.column("_trusted").to_pylist()
            each = [_buckets(words[rows[i]:rows[i + 1]]) for i in range(part.num_rows)]
            for side, some in ((0, each), (1, [x for x, t in zip(each, trusted, strict=True) if t])):
                if some:
                    total[side] += np.bincount(np.concatenate(some), minlength=BUCKETS)
    bucket = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(total[0][bucket]), pa.array(total[1][bucket])], ["bucket", "raw", "target"])


@dataclass
class QualityModel:
    """Log ratio of target and corpus probability for each bucket."""

    ratio: np.ndarray


def fit_quality(df: DataFrame, trusted: Column, text: str = "text") -> QualityModel:
    """Two multinomials over hashed words and word pairs: all texts, and those that are trusted.

    Every text counts.  A task sends one row per bucket and no more, and the sums, BUCKETS rows at
    most, come to the driver.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"), F.coalesce(trusted, F.lit(False)).alias("_trusted"))
    sums = rows.mapInArrow(_gram_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, BUCKETS))
    counts[:, sums.column("bucket").to_numpy()] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    if not counts[1].sum():
        return QualityModel(np.zeros(BUCKETS))
    # The target is drawn towards the corpus: a bucket the target rarely sees gets the corpus's share.
    raw = (counts[0] + SMOOTH) / (counts[0] + SMOOTH).sum()
    target = counts[1] + SMOOTH * BUCKETS * raw
    return QualityModel(np.log(target / target.sum()) - np.log(raw))


def _judge(shared, threshold: float, text: str, rest: list[str]) -> Callable:
    def run(batches):
        ratio = shared.value.ratio
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                data, offsets, starts, ends, words, rows = _texts(part.column(text))
                # Code points up to each byte: bytes that do not continue a sequence.
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                letters = np.r_[0, np.cumsum(points[ends] - points[starts])]
                symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
                out = np.zeros((5, part.num_rows), np.int64)
                score = np.zeros(part.num_rows)
                for i in range(part.num_rows):
                    own, low, high = words[rows[i]:rows[i + 1]], offsets[i], offsets[i + 1]
                    grams = _buckets(own)
                    out[:, i] = (len(own), letters[rows[i + 1]] - letters[rows[i]], symbols[high] - symbols[low],
                                 _duplicate_lines(data, starts, low, high), _repeated_words(own))
                    score[i] = ratio[grams].mean() if len(grams) else 0.0
                failed = (out[0] < 20) | (100 * out[4] > 30 * out[0])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in rest], *map(pa.array, out), pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))],
                    [*rest, *_ADDED],
                )
    return run


_ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio", "base_failed", "kept"]


def judge_quality(
    df: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True,
) -> DataFrame:
    """Every row of ``df`` with base counts, log_ratio and the verdict ``kept``.

    Words are runs outside ``[\\x20\\x09-\\x0D]``.  n_words; word_chars (code points in words);
    n_symbols (``#*$%&|<>``); n_dup_lines (lines with a word that equal an earlier one);
    n_repeat_words (words in windows of eight words found twice or more).  base_failed: fewer than
    20 words, or over 30 % repeated words.  log_ratio is the mean over the text's words and word
    pairs of log P(target) - log P(corpus); kept: not base_failed and log_ratio >= threshold, the
    same for every document.  A null text counts as empty: all counts 0, failed, not kept.  Input
    columns named like an added one are replaced; an empty table gives an empty result.  With
    ``keep_text=False`` the text column is left out and does not travel back.
    """
    work = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in _ADDED])
    rest = [c for c in work.columns if keep_text or c != text]
    schema = StructType([work.schema[c] for c in rest])
    for name in _ADDED:
        schema = schema.add(name, "double" if name == "log_ratio" else "boolean" if name in ("base_failed", "kept") else "long")
    return work.mapInArrow(_judge(df.sparkSession.sparkContext.broadcast(model), threshold, text, rest), schema)
