"""Byte-level BPE with a given rank file: texts to token ids and back.

Every match of the vocabulary's pattern is encoded by itself.  A match that is a token as a whole is
that token.  Otherwise the leaves of a segment tree stand for the bytes where a live token begins;
each holds the rank of that token joined with its right neighbour, an inner node the least of its
children, the left one among equal ranks.  The root thus names the next merge, which changes three
leaves (the merged token's, its left neighbour's and the one that goes) and the nodes above them.
A match of n bytes costs O(n log n), however long it is.

Short matches are merged many at a time: all their trees are rows of one array, and a step makes the
next merge of each.  Long ones, which are rare, are merged one by one.

Patterns are those whose matches hold white space at their beginning or consist of it, as the public
ones' do.  So no match reaches over a place in front of white space that follows something else; long
texts are cut there, and memory follows the part and the ids.  Matches are remembered with their ids
in a table of bounded size per Python worker, which is emptied when full; it changes the time only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from postloom.llm.wordhash import flat, slices

#: Characters matched at once, matches remembered per worker, the longest of them, and cells of trees held at once.
CUT, MEMORY, LONGEST, CELLS = 1 << 20, 1 << 19, 64, 1 << 17
#: The characters that Unicode calls white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_gap = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
#: Leaves of trees that are worked side by side; a longer match has a tree of its own.
WIDTHS = (8, 16, 32, 64)
_known: dict[tuple, dict[str, bytes]] = {}
_pairs: dict[str, "Pairs"] = {}


class Vocabulary:
    """Ranks of byte strings, which are the token ids too, and the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"single bytes without a rank: {missing[:5]}")
        if len(set(ranks.values())) < len(ranks) or min(ranks.values()) < 0 or max(ranks.values()) >= 1 << 32:
            raise ValueError("ranks are different unsigned 32-bit numbers")
        self.ranks, self.pattern = ranks, pattern

    def digest(self) -> str:
        """Names the vocabulary; tables of remembered matches are kept apart by it."""
        state = hashlib.sha256(self.pattern.encode())
        for token, rank in self.ranks.items():
            state.update(b"%d:%d:" % (rank, len(token)) + token)
        return state.hexdigest()


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file, one ``base64(token) rank`` a line, read on the driver; tasks get it with the function."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


def merge_ranks(piece: bytes, rank_of: Callable[[bytes], int | None]) -> list[int]:
    """Token ids of one match after all merges."""
    n = len(piece)
    size = 1 << max(0, n - 2).bit_length()  # leaves: one per pair of neighbours, at least one
    shift = n.bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = rank_of(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        node = size + i
        tree[node] = key
        while node > 1:
            other = tree[node ^ 1]
            if other < key:
                key = other
            node >>= 1
            if tree[node] == key:
                return
            tree[node] = key

    low = (1 << shift) - 1
    while tree[1] != none:
        i = tree[1] & low
        gone = end[i]
        stop = end[gone]
        end[i] = stop
        put(gone, none) if gone < n - 1 else None
        rank = None
        if stop < n:
            before[stop] = i
            rank = rank_of(piece[i:end[stop]])
        put(i, none if rank is None else rank << shift | i)
        left = before[i]
        if left >= 0:
            rank = rank_of(piece[left:stop])
            put(left, none if rank is None else rank << shift | left)
    ids, i = [], 0
    while i < n:
        ids.append(rank_of(piece[i:end[i]]))
        i = end[i]
    return ids


def cuts(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about ``size`` characters; no match reaches over their ends."""
    size, at = size or CUT, 0
    while len(text) - at > size:
        gap = _gap.search(text, at + size)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


class Pairs:
    """Which two tokens make which third, by numbers that follow the order of the ranks.

    ``of(a, b)`` looks whole arrays up in an open hash table; where two tokens make none, ``none`` comes
    back.  The number ``none`` itself is in no pair.
    """

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        number = {t: i for i, t in enumerate(tokens)}
        self.none = len(tokens)
        self.ids = np.array([ranks[t] for t in tokens], "<u4")
        self.bytes = np.array([number[bytes([b])] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for token, i in number.items():
            for at in range(1, len(token)):
                a, b = number.get(token[:at]), number.get(token[at:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        made = np.array(made, np.int64)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        at, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = self.keys[at[open_]] < 0
            self.keys[at[open_[free]]] = keys[open_[free]]  # of several, one stays
            mine = self.keys[at[open_]] == keys[open_]
            self.made[at[open_[mine]]] = made[open_[mine]]
            open_ = open_[~mine]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = self._slot(keys)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return np.where(self.keys[at] == keys, self.made[at], self.none)


def merge_many(pieces: list[bytes], pairs: Pairs, width: int) -> list[bytes]:
    """Packed ids of many matches of at most ``width`` - 2 bytes, all their trees side by side.

    Place 0 and the place behind the last byte hold the number that is in no pair, so that the first
    and last token need no case of their own.  A leaf's key is the made token's number, then the place.
    """
    n, levels, none = len(pieces), width.bit_length() - 1, pairs.none
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    token = np.full((n, width), none, np.int64)
    inside = np.arange(width) - 1
    inside = (inside >= 0) & (inside < sizes[:, None])
    token[inside] = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    follow = np.tile(np.arange(1, width + 1, dtype=np.int64), n)
    before = np.tile(np.arange(-1, width - 1, dtype=np.int64), n)
    nothing = none << levels
    leaves = np.full((n, width), nothing, np.int64)
    row, place = np.nonzero(inside[:, :-1] & inside[:, 1:])
    made = pairs.of(token[row, place], token[row, place + 1])
    leaves[row, place] = np.where(made < none, made << levels | place, nothing)
    tree = np.empty((n, 2 * width), np.int64)
    tree[:, width:] = leaves
    at = width
    while at > 1:
        at //= 2
        tree[:, at:2 * at] = tree[:, 2 * at:4 * at].reshape(n, at, 2).min(axis=2)
    token, tree = token.ravel(), tree.ravel()
    live = np.flatnonzero(tree[1::2 * width] < nothing)
    while len(live):
        row, root = live * width, live * (2 * width)
        key = tree[root + 1]
        place, new = key & (width - 1), key >> levels
        here = row + place
        gone = follow[here]
        behind = follow[row + gone]
        left = before[here]
        token[here] = new
        follow[here] = behind
        before[row + behind] = place
        made = pairs.of(np.concatenate([new, token[row + left]]), np.concatenate([token[row + behind], new]))
        places = np.concatenate([place, left])
        value = np.where(made < none, made << levels | places, nothing)
        tree[root + width + gone] = nothing
        roots = np.concatenate([root, root, root])
        node = np.concatenate([places, gone]) + width
        tree[roots[:len(places)] + node[:len(places)]] = value
        for _ in range(levels):
            node >>= 1
            below = roots + 2 * node
            tree[roots + node] = np.minimum(tree[below], tree[below + 1])
        live = live[tree[root + 1] < nothing]
    first = np.zeros((n, width + 1), bool)  # where a live token begins
    place, row = np.ones(n, np.int64), np.arange(n)
    counts = np.zeros(n, np.int64)
    while len(row):
        first[row, place] = True
        counts[row] += 1
        place = follow[row * width + place]
        more = place <= sizes[row]
        row, place = row[more], place[more]
    packed = pairs.ids[token.reshape(n, width)[first[:, :width]]].tobytes()
    ends = np.cumsum(counts) * 4
    return [packed[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist())]


def encode_matches(matches: Iterable[str], ranks: dict[bytes, int], pairs: Pairs) -> dict[str, bytes]:
    """Packed ids of different matches."""
    known, groups = {}, {w: ([], []) for w in WIDTHS}
    short = [groups[next(w for w in WIDTHS if n + 2 <= w)] for n in range(WIDTHS[-1] - 1)]
    for match in matches:
        piece = match.encode()
        whole = ranks.get(piece)
        if whole is not None:
            known[match] = whole.to_bytes(4, "little")
        elif len(piece) + 2 > WIDTHS[-1]:
            known[match] = np.array(merge_ranks(piece, ranks.get), "<u4").tobytes()
        else:
            names, pieces = short[len(piece)]
            names.append(match)
            pieces.append(piece)
    for width, (names, pieces) in groups.items():
        step = CELLS // (2 * width)
        for at in range(0, len(names), step):
            known.update(zip(names[at:at + step], merge_many(pieces[at:at + step], pairs, width)))
    return known


def encoder(ranks: dict[bytes, int], pattern: str, name: str, memory: int = MEMORY) -> Callable[[Iterable[str]], Iterator[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit integers."""
    known = _known.setdefault((name, memory), {})
    if name not in _pairs:
        _pairs[name] = Pairs(ranks)
    find, pairs = regex.compile(pattern).findall, _pairs[name]

    def encode_parts(parts: list[str]) -> list[bytes]:
        found = [find(part) for part in parts]
        wanted = set().union(*found)
        new = [m for m in wanted if m not in known]
        if len(known) + len(new) > memory:
            known.clear()
            new = wanted
        known.update(encode_matches(new, ranks, pairs))
        ids = [b"".join(map(known.__getitem__, matches)) for matches in found]
        for long in [m for m in new if len(m) > LONGEST]:
            del known[long]
        if len(known) > memory:
            known.clear()
        return ids

    def encode(texts: Iterable[str]) -> Iterator[bytes]:
        waiting, size, open_ = [], 0, []  # parts, their characters, and the ids of an unfinished text

        def flush():
            for (last, _), ids in zip(waiting, encode_parts([p for _, p in waiting])):
                open_.append(ids)
                if last:
                    yield b"".join(open_)
                    open_.clear()
            waiting.clear()

        for text in texts:
            parts = list(cuts(text))
            for i, part in enumerate(parts):
                waiting.append((i == len(parts) - 1, part))
                size += len(part)
                if size >= CUT:
                    yield from flush()
                    size = 0
        yield from flush()

    return encode


def decode_ids(packed: pa.Array, ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of every row of packed ids; about ``CUT`` ids (or one longer row) are worked at a time."""
    tokens = sorted(ranks, key=ranks.get)
    known = np.array([ranks[t] for t in tokens], np.uint32)
    dense = int(known[-1]) == len(known) - 1
    sizes = np.array([len(t) for t in tokens])
    begins = np.cumsum(sizes) - sizes
    vocabulary = np.frombuffer(b"".join(tokens), np.uint8)
    parts = []
    for _, part in slices(packed, 4 * CUT):
        data, offsets = flat(part)
        if (offsets % 4).any():
            raise ValueError("packed ids of a length that no whole number of ids has")
        ids = np.frombuffer(data.tobytes(), "<u4")
        token = ids if dense else np.searchsorted(known, ids)
        bad = token >= len(known) if dense else known[np.minimum(token, len(known) - 1)] != ids
        if bad.any():
            raise ValueError(f"ids without a token: {ids[bad][:5].tolist()}")
        size = sizes[token]
        ends = np.r_[0, np.cumsum(size)]
        out = vocabulary[np.arange(ends[-1]) + np.repeat(begins[token] - ends[:-1], size)]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends[offsets // 4]), pa.py_buffer(out)]).cast(pa.binary())
        parts.append(pc.if_else(part.is_valid(), whole, pa.scalar(None, pa.binary())) if part.null_count else whole)
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def bpe_encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text in a binary column ``out``.

    Ids are packed as little-endian unsigned 32-bit integers, as training files hold them (``unpack_ids``
    gives an array).  A null text counts as empty and has no ids.  All other columns and all rows stay
    as they are, repeated rows and null keys included; a column that is called ``out`` is replaced.
    Nothing is shuffled; only the text travels to the Python workers.
    """
    ranks, pattern, name = vocabulary.ranks, vocabulary.pattern, vocabulary.digest()

    @F.arrow_udf(BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(encoder(ranks, pattern, name)(t.as_py() or "" for t in texts), pa.binary())

    return docs.withColumn(out, encode(F.col(f"`{text}`")))


def bpe_decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the packed ids in ``ids`` stand for in a binary column ``out``.

    Null ids have null bytes; an id that no token has, and packed ids of a length that no whole number
    of them has, fail the job.  Bytes of ids that do not come from a text need not be UTF-8.
    """
    ranks = vocabulary.ranks

    @F.arrow_udf(BinaryType())
    def decode(packed: pa.Array) -> pa.Array:
        return decode_ids(packed, ranks)

    return rows.withColumn(out, decode(F.col(f"`{ids}`")))


def count_ids(packed: Column) -> Column:
    """The number of packed ids."""
    return F.floor(F.octet_length(packed) / 4).cast("long")


def unpack_ids(packed: Column) -> Column:
    """Packed ids as an array of longs."""
    digits = F.hex(packed)
    turned = lambda at: F.concat(*[F.substr(digits, at * 8 + F.lit(1 + 2 * b), F.lit(2)) for b in (3, 2, 1, 0)])
    places = F.when(F.octet_length(packed) >= 4, F.sequence(F.lit(0), (count_ids(packed) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: F.conv(turned(at), 16, 10).cast("long"))
