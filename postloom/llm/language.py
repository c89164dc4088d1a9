"""Language identification by unigram piece models, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from sys import maxunicode
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.llm.scratch import Scratch
from postloom.llm.wordhash import hash_slices, mix, slices

#: Mark of a word's start in the vocabulary.
START = "▁"
#: Words up to this length are summed many at a time; longer ones one by one, in logarithms.
RUN = 31
#: Least probability of a piece; RUN pieces of it still make a normal double.
FLOOR = 1e-8
MAX_LANGUAGES = 200
#: Words a task counts before it starts anew, and scores it keeps.
HELD_WORDS, HELD_SCORES = 150_000, 4_000_000
#: Letters of a part of a long text, unless a word is longer, and letters a task holds as numbers at once.
PART, GROUP = 1_000_000, 4_000_000
_BASE = np.uint64(0x100000001B3)
_LETTER, _MARK = 2, 1


@cache
def _kinds() -> np.ndarray:
    """For every code point: a letter (Unicode category L), a mark that may follow one (M), or neither."""
    kind = {"L": _LETTER, "M": _MARK}
    return np.fromiter((kind.get(category(chr(i))[0], 0) for i in range(maxunicode + 1)), np.uint8)


def load_pieces(path: str) -> list[str]:
    """The lower-case letter pieces of a public vocabulary file (read on the driver)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p == p.lower() and (p == START or p.removeprefix(START).isalpha()) and len(p) <= 16)


def text_parts(text: str | None) -> Iterator[str]:
    """The lower-cased text in parts that end outside words; where depends on the text alone."""
    kinds, low, at = _kinds(), (text or "").lower(), 0
    while at < len(low):
        upto = at + PART
        while upto < len(low) and kinds[ord(low[upto - 1])]:
            upto += 1
        yield low[at:upto] if at or upto < len(low) else low
        at = upto


def part_groups(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """The parts of all texts, and the row of each, about GROUP letters at a time."""
    rows, parts, held = [], [], 0
    for first, some in slices(column):
        for i, text in enumerate(some.to_pylist()):
            for part in text_parts(text):
                rows.append(first + i)
                parts.append(part)
                held += len(part)
                if held >= GROUP:
                    yield rows, parts
                    rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


class Words:
    """The words of some parts of texts: runs of letters and marks with a letter in them.

    ``hashes`` and ``part`` have one entry per word, in order.
    """

    def __init__(self, parts: list[str]):
        self.joined = "\n".join(parts)
        codes = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        kind = _kinds()[codes]
        edges = np.flatnonzero(np.diff(kind > 0, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        if (kind == _MARK).any():
            letters = np.r_[0, np.cumsum(kind == _LETTER)]
            real = letters[self.ends] > letters[self.starts]
            self.starts, self.ends = self.starts[real], self.ends[real]
        self.hashes = hash_slices(codes, self.starts, self.ends)
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.part = np.searchsorted(begins, self.starts, "right") - 1

    def spell(self, which: np.ndarray) -> list[str]:
        """The chosen words, marked START."""
        return [START + self.joined[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


class Lattice:
    """Looks up every piece in many words of one length at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)  # the id of an unknown letter; one more row, of zeros, is no piece
        self.by_length: dict = {}
        lengths = np.array([len(p) for p in pieces])
        for n in np.unique(lengths).tolist():
            ids = np.flatnonzero(lengths == n)
            hashes = self._hash(np.array([pieces[i] for i in ids], f"U{n}").view(np.uint32).reshape(-1, n))[:, -1]
            order = np.argsort(hashes)
            self.by_length[n] = (hashes[order], ids[order])
        self.lengths = sorted({1, *self.by_length})  # an unknown letter has one

    @staticmethod
    def _hash(letters: np.ndarray) -> np.ndarray:
        sums = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
        for j in range(letters.shape[1]):
            sums[:, j + 1] = sums[:, j] * _BASE + letters[:, j] + np.uint64(1)
        return sums

    def edges(self, words: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """(from, to, piece of every word there) for words of one length, in order of from."""
        n = len(words[0])
        sums = self._hash(np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n))
        out = []
        for j in range(n):
            for length in self.lengths:
                if j + length > n:
                    break
                power = np.uint64(pow(int(_BASE), length, 1 << 64))
                piece = self._find(length, sums[:, j + length] - sums[:, j] * power)
                if (piece <= self.size).any():
                    out.append((j, j + length, piece))
        return out

    def _find(self, length: int, value: np.ndarray) -> np.ndarray:
        piece = np.full(len(value), self.size if length == 1 else self.size + 1)
        if length in self.by_length:
            hashes, ids = self.by_length[length]
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            real = hashes[at] == value
            piece[real] = ids[at[real]]
        return piece

    def edges_of(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of one word of any length, in order of from."""
        codes = np.array([word]).view(np.uint32).astype(np.uint64) + np.uint64(1)
        value, found = np.zeros(len(codes) + 1, np.uint64), []
        for length in range(1, min(len(codes), self.lengths[-1]) + 1):
            value = value[:len(codes) - length + 1] * _BASE + codes[length - 1:]
            piece = self._find(length, value)
            at = np.flatnonzero(piece <= self.size)
            found.append((at, at + length, piece[at]))
        begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order], piece[order]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and words of equal length, up to RUN; in alphabetical order, as like words are looked up faster in a row."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = order[np.argsort(lengths[order], kind="stable")]
    for n in np.unique(lengths[lengths <= RUN]):
        low, high = np.searchsorted(lengths, [n, n + 1], sorter=order)
        for i in range(low, high, 20_000):
            at = order[i:min(i + 20_000, high)]
            yield at, [words[x] for x in at.tolist()]


def long_words(words: list[str], table: np.ndarray) -> Iterator[tuple[int, str, slice]]:
    """Place and word of every word longer than RUN, with a few languages at a time if it is very long."""
    for i, word in enumerate(words):
        if len(word) > RUN:
            step = max(1, 4 * PART // len(word))
            for language in range(0, table.shape[1], step):
                yield i, word, slice(language, language + step)


def log_sums(n: int, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of all positions 0 to n, the log of the sum over all paths from 0, given edges and their log weights."""
    order = np.argsort(end, kind="stable")
    begin, weight = begin[order], weight[order]
    bounds = np.searchsorted(end[order], np.arange(n + 2))
    out = np.zeros((n + 1, weight.shape[1]))
    for k in range(1, n + 1):
        low, high = bounds[k], bounds[k + 1]
        out[k] = np.logaddexp.reduce(out[begin[low:high]] + weight[low:high], axis=0)
    return out


def word_scores(lattice: Lattice, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word under each language: the forward algorithm over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    for at, some in by_length(words):
        n = len(some[0])
        forward = np.zeros((n + 1, len(some), table.shape[1]))
        forward[0] = 1
        for j, k, piece in lattice.edges(some):
            forward[k] += forward[j] * table[piece]
        out[at] = np.log(forward[n])
    for i, word, some in long_words(words, table):
        begin, end, piece = lattice.edges_of(word)
        out[i, some] = log_sums(len(word), begin, end, np.log(table[piece, some]))[-1]
    return out


def expected_pieces(lattice: Lattice, table: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, over all segmentations of the counted words."""
    out = np.zeros_like(table)
    for at, some in by_length(words):
        n, size = len(some[0]), (len(some), table.shape[1])
        edges = lattice.edges(some)
        forward, backward = np.zeros((n + 1, *size)), np.zeros((n + 1, *size))
        forward[0] = backward[n] = 1
        for j, k, piece in edges:
            forward[k] += forward[j] * table[piece]
        for j, k, piece in reversed(edges):
            backward[j] += backward[k] * table[piece]
        weight = counts[at] / forward[n]
        for j, k, piece in edges:
            share = forward[j] * backward[k] * table[piece] * weight
            for language in range(size[1]):
                out[:, language] += np.bincount(piece, share[:, language], len(out))
    for i, word, some in long_words(words, table):
        n, (begin, end, piece) = len(word), lattice.edges_of(word)
        weight = np.log(table[piece, some])
        forward, backward = log_sums(n, begin, end, weight), log_sums(n, n - end, n - begin, weight)[::-1]
        share = np.exp(forward[begin] + backward[end] + weight - forward[n]) * counts[i, some]
        for language in range(share.shape[1]):
            out[:, some.start + language] += np.bincount(piece, share[:, language], len(out))
    out[-1] = 0
    return out


@dataclass
class LanguageModel:
    """languages in code point order, their log priors, and P(piece | language), one column each.

    The last row but one is an unknown letter, the last one, of zeros, no piece.
    """

    languages: list[str]
    priors: np.ndarray
    pieces: list[str]
    table: np.ndarray


def _count_by_language(languages: list[str]) -> Callable:
    place = {x: i for i, x in enumerate(languages)}

    def add_up(held):
        """Equal words of one language counted together: (key, language, count, words)."""
        key, language, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        words = [w for h in held for w in h[3]]
        return key[first], language[first], np.bincount(at, n, len(first)).astype(np.int64), [words[i] for i in first.tolist()]

    def rows(language, n, words):
        return pa.RecordBatch.from_arrays(
            [pa.array(language.astype(np.int32)), pa.array(words, pa.string()), pa.array(n)], ["language", "word", "n"])

    def run(batches):
        held: list = []
        for batch in batches:
            spoken = np.array([place[x] for x in batch.column("_lang").to_pylist()], np.int64)
            for at, parts in part_groups(batch.column("_text")):
                words = Words(parts)
                language = spoken[at][words.part]
                key, first, n = np.unique(mix(words.hashes + mix(language.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
                held.append((key, language[first], n, words.spell(first)))
                if sum(len(h[0]) for h in held) > 2 * HELD_WORDS or sum(sum(map(len, h[3])) for h in held) > 16 * PART:
                    held = [add_up(held)]
                    if len(held[0][0]) > HELD_WORDS or sum(map(len, held[0][3])) > 8 * PART:
                        yield rows(*held.pop()[1:])
        if held:
            yield rows(*add_up(held)[1:])
    return run


def _expect(shared) -> Callable:
    def word_groups(batches):
        """Languages, words and counts of many batches together."""
        some, held = [], 0
        for batch in batches:
            some.append(batch)
            held += batch.num_rows
            if held > HELD_WORDS:
                yield pa.Table.from_batches(some)
                some, held = [], 0
        if some:
            yield pa.Table.from_batches(some)

    def run(batches):
        pieces, table = shared.value
        lattice, total = Lattice(pieces), np.zeros(table.shape)
        for group in word_groups(batches):
            spoken, words = group.column("language").to_numpy(), group.column("word").to_pylist()
            counts = group.column("n").to_numpy()
            # A word counts for its own language only.
            for language in np.unique(spoken).tolist():
                at = np.flatnonzero(spoken == language)
                found = expected_pieces(lattice, table[:, [language]], [words[i] for i in at.tolist()], counts[at][:, None])
                total[:, language] += found[:, 0]
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, language])],
            ["language", "piece", "uses"],
        )
    return run


def fit_languages(df: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", rounds: int = 3) -> LanguageModel:
    """Learn P(piece | language) from every row with a text and a language.

    Words are counted by language once (partial counts in the tasks, then a sum).  Each round of
    expectation-maximisation reads that table; what it sends to the driver is one number per piece
    and language, so its size is bounded by the fixed vocabulary times MAX_LANGUAGES.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_lang is not null and _text is not null")
    sizes = rows.groupBy("_lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sizes = sorted((r[0], r[1]) for r in sizes)
    languages = [x for x, _ in sizes]
    if not languages:
        return LanguageModel([], np.zeros(0), pieces, np.zeros((len(pieces) + 2, 0)))
    words = scratch.keep(
        rows.mapInArrow(_count_by_language(languages), "language int, word string, n long")
        .groupBy("language", "word").agg(F.sum("n").alias("n"))
    )
    table = np.full((len(pieces) + 2, len(languages)), 1 / len(pieces))
    table[-2], table[-1] = FLOOR, 0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, table))
        uses = words.mapInArrow(_expect(shared), "language int, piece int, uses double").groupBy("language", "piece").agg(F.sum("uses").alias("uses"))
        found = uses.toArrow()
        table = np.full(table.shape, 0.05)
        table[found.column("piece").to_numpy(), found.column("language").to_numpy()] += found.column("uses").to_numpy()
        table = np.maximum(table / table.sum(0), FLOOR)
        table[-1] = 0
        shared.unpersist()
    scratch.drop(words)
    total = sum(n for _, n in sizes)
    return LanguageModel(languages, np.log([n / total for _, n in sizes]), pieces, table)


def _predict(shared, text: str, rest: list[str]) -> Callable:
    def run(batches):
        model = shared.value
        lattice, size = Lattice(model.pieces), len(model.languages)
        known, scores = np.zeros(0, np.uint64), np.zeros((0, size))
        for batch in batches:
            total, spoken = np.zeros((batch.num_rows, size)), np.zeros(batch.num_rows, bool)
            for rows, parts in part_groups(batch.column(text)):
                words = Words(parts)
                if not len(words.hashes):
                    continue
                distinct, first, at = np.unique(words.hashes, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
                fresh = known[place] != distinct if len(known) else np.ones(len(distinct), bool)
                if fresh.any():
                    if len(known) * size > HELD_SCORES:
                        known, scores, fresh = known[:0], scores[:0], np.ones(len(distinct), bool)
                    known = np.concatenate([known, distinct[fresh]])
                    scores = np.concatenate([scores, word_scores(lattice, model.table, words.spell(first[fresh]))])
                    order = np.argsort(known)
                    known, scores = known[order], scores[order]
                    place = np.searchsorted(known, distinct)
                # Each part of a text is summed by itself, so the result depends on the text alone.
                heads = np.flatnonzero(np.diff(words.part, prepend=-1))
                row = np.array(rows)[words.part[heads]]
                for language in range(size):
                    np.add.at(total[:, language], row, np.add.reduceat(scores[place, language][at], heads))
                spoken[row] = size > 0
            found, best = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if spoken.any():
                total = total[spoken] + model.priors
                found[spoken] = np.array(model.languages, object)[total.argmax(1)]
                best[spoken] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            same = [batch.column(name) for name in rest]
            yield pa.RecordBatch.from_arrays([*same, pa.array(found, pa.string()), pa.array(best, pa.float64())], [*rest, "lang_pred", "score"])
    return run


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of ``df`` with lang_pred and score (the posterior of lang_pred, 0 to 1).

    All words of the whole text count, as runs of letters (Unicode category L) and marks, however long; a
    text's log probability is the sum over its words of
    the log of the forward algorithm, which adds up all segmentations into pieces.  Words are told apart by 64-bit hashes.  A null text,
    one without letters, or a model without languages gives ``und`` and score 0; of equal scores
    the first language in code point order wins.  Only the text is read.  Columns of the input
    named lang_pred or score are replaced; an empty table gives an empty result.  With
    ``keep_text=False`` the text column is left out and does not travel back.
    """
    work = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")])
    rest = [c for c in work.columns if keep_text or c != text]
    schema = StructType([work.schema[c] for c in rest]).add("lang_pred", "string").add("score", "double")
    return work.mapInArrow(_predict(df.sparkSession.sparkContext.broadcast(model), text, rest), schema)
