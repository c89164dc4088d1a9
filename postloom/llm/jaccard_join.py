"""Exact n-gram Jaccard join of a corpus with itself by T-occurrence search."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.components import connected_components
from postloom.llm.scratch import Scratch, tasks
from postloom.llm.wordhash import SHINGLE, mix, shingle_lists

#: Share of a text's shingles that its prefix holds beyond the least that exactness needs.
SPARE = 15
#: A block pair of one candidate group has at most so many texts and shingles on either side.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 20
#: Postings that a task sorts at once.
SORT_POSTINGS = 1_500_000
#: Survivors are broadcast to the texts up to this number, 24 bytes each, else joined by shuffle.
MAX_BROADCAST = 1_000_000

BLOB = "bucket int, docs binary, ns binary, counts binary, keys binary"


def ceil_share(n, percent: int):
    return -(-n * percent // 100)


def spare(n: int, percent: int) -> int:
    """How many of the shared shingles the prefixes of two similar texts must have in common."""
    return min(max(1, n * SPARE // 100), ceil_share(n, percent))


def class_id(shingles: np.ndarray) -> int:
    """A signed 64-bit id of a set of shingles."""
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64)]) + np.uint64(len(shingles)))[0].astype(np.int64))


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, found in shingle_lists(column, n):
        yield i, np.unique(found)


def signatures(shingle: int) -> Callable:
    def run(batches):
        for batch in batches:
            ids, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for i, found in _sets(batch.column("_text"), shingle):
                ids[i], sizes[i] = class_id(found), len(found)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(ids), pa.array(sizes)], ["_key", "cls", "n"])
    return run


# --- postings as packed rows: one row per task, bucket and flush ---------------------


def pack(docs: list[int], ns: list[int], lists: list[np.ndarray], buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Deal the keys of texts out by bucket.  Of a key the bucket and ``width`` top bytes are kept."""
    counts = np.array([len(x) for x in lists], np.int64)
    keys = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    if not len(keys):
        return
    owner = np.repeat(np.arange(len(docs)), counts)
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, owner, bucket = keys[order], owner[order], bucket[order]
    doc_ids, sizes = np.array(docs, np.int64), np.array(ns, np.uint32)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    out = [[], [], [], [], []]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        own = owner[low:high]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[0].append(int(bucket[low]))
        out[1].append(doc_ids[own[at]].tobytes())
        out[2].append(sizes[own[at]].tobytes())
        out[3].append(np.diff(np.r_[at, high - low]).astype(np.uint32).tobytes())
        out[4].append(keys[low:high].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    yield pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["bucket", "docs", "ns", "counts", "keys"],
    )


def unpack(batches, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one partition: text, its size and key of every posting, sorted by key and then text."""
    docs, ns, keys = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], np.uint32)
            docs.append(np.repeat(np.frombuffer(row["docs"], np.int64), counts))
            ns.append(np.repeat(np.frombuffer(row["ns"], np.uint32), counts))
            wide = np.zeros((len(docs[-1]), 8), np.uint8)
            wide[:, :width] = np.frombuffer(row["keys"], np.uint8).reshape(-1, width)
            # Where low bytes were cut, the bucket keeps keys of different buckets apart.
            low = np.uint64(row["bucket"] & 0xFFFF) if width < 8 else np.uint64(0)
            keys.append(wide.view(">u8").ravel().astype(np.uint64) | low)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    docs, ns, keys = np.concatenate(docs), np.concatenate(ns), np.concatenate(keys)
    order = np.lexsort((docs, keys))
    docs, ns, keys = docs[order], ns[order], keys[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]
    return docs[fresh], ns[fresh], keys[fresh]


def frequencies(keys: np.ndarray) -> np.ndarray:
    """How many entries have the same key, for each entry of a sorted array."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[at, len(keys)])
    return np.repeat(counts, counts)


def prefixes(shingle: int, percent: int, buckets: int) -> Callable:
    """Postings of each set's least hashes, long enough for ``spare`` shared ones; copies once a task."""
    def run(batches):
        seen, docs, ns, lists, held = set(), [], [], [], 0
        for batch in batches:
            for _, found in _sets(batch.column("_text"), shingle):
                n = len(found)
                if not n or (cls := class_id(found)) in seen:
                    continue
                if len(seen) < 2_000_000:
                    seen.add(cls)
                docs.append(cls)
                ns.append(n)
                lists.append(found[:n - ceil_share(n, percent) + spare(n, percent)].copy())
                held += len(lists[-1])
                if held >= SORT_POSTINGS:
                    yield from pack(docs, ns, lists, buckets, 6)
                    docs, ns, lists, held = [], [], [], 0
        yield from pack(docs, ns, lists, buckets, 6)
    return run


def shared_counts(batches):
    """How many keys of each text in this partition another text has, too."""
    docs, _, keys = unpack(batches, 6)
    docs = np.sort(docs[frequencies(keys) > 1])
    at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(np.diff(np.r_[at, len(docs)]).astype(np.int64))], ["cls", "hits"])


def survivor_sets(shingle: int) -> Callable:
    """The whole sets of the texts that are left, once per class and task."""
    def run(batches):
        seen = set()
        for batch in batches:
            want, copies = batch.column("cls").to_pylist(), batch.column("copies").to_pylist()
            docs, ns, many, sets = [], [], [], []
            for i, found in _sets(batch.column("_text"), shingle):
                if class_id(found) == want[i] and want[i] not in seen:
                    seen.add(want[i])
                    docs.append(want[i])
                    ns.append(len(found))
                    many.append(copies[i])
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(ns, pa.int32()), pa.array(many, pa.int64()), pa.array(sets, pa.binary())],
                ["cls", "n", "copies", "shingles"],
            )
    return run


def all_postings(buckets: int) -> Callable:
    def run(batches):
        docs, ns, lists, held = [], [], [], 0
        for batch in batches:
            for cls, n, raw in zip(*[batch.column(c).to_pylist() for c in ("cls", "n", "shingles")], strict=True):
                docs.append(cls)
                ns.append(n)
                lists.append(np.frombuffer(raw, np.uint64))
                held += n
                if held >= SORT_POSTINGS:
                    yield from pack(docs, ns, lists, buckets, 8)
                    docs, ns, lists, held = [], [], [], 0
        yield from pack(docs, ns, lists, buckets, 8)
    return run


def shared_keys(parts: int) -> Callable:
    """Keys of this partition that several texts have, with their number, packed by the text's new partition."""
    def run(batches):
        docs, ns, keys = unpack(batches, 8)
        count = frequencies(keys)
        keep = count > 1
        part = (mix(docs[keep].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        docs, ns, keys, count = (x[keep][order] for x in (docs, ns, keys, count.astype(np.uint32)))
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        cuts = list(zip(at[:-1], at[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(part[a]) for a, _ in cuts], pa.int32()), *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (docs, ns, keys, count)]],
            ["part", "docs", "ns", "keys", "texts"],
        )
    return run


def rare_prefixes(percent: int, buckets: int) -> Callable:
    """Set the long lists aside: of every text keep the shared keys among its rarest n - T + 1.

    A text with fewer than T shared keys in all cannot reach the overlap and is dropped.
    """
    def run(batches):
        read = {"docs": np.int64, "ns": np.uint32, "keys": np.uint64, "texts": np.uint32}
        found: dict = {name: [np.zeros(0, kind)] for name, kind in read.items()}
        for batch in batches:
            for name, kind in read.items():
                found[name] += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
        docs, ns, keys, texts = (np.concatenate(found[name]) for name in read)
        if not len(docs):
            return
        order = np.lexsort((keys, texts, docs))
        docs, ns, keys = docs[order], ns[order], keys[order]
        at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True])
        kept: list = [[], [], []]
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = int(ns[a])
            least = ceil_share(n, percent)
            rare = (n - least + 1) - (n - (b - a))  # the unshared keys come first and take their places
            if b - a >= least and rare > 0:
                kept[0].append(int(docs[a]))
                kept[1].append(n)
                kept[2].append(keys[a:a + rare])
        yield from pack(*kept, buckets, 8)
    return run


def stars(batches):
    """Tie the texts of each list to the least of them."""
    docs, _, keys = unpack(batches, 8)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    centre = np.repeat(docs[first], np.diff(np.r_[first, len(docs)]))
    edges = np.unique(np.stack([docs, centre], 1)[docs != centre], axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


# --- search inside a cell ------------------------------------------------------------


def divide_skip(queries: list[np.ndarray], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query set the positions of all ``sets`` it may reach, with the exact overlaps.

    The inverted lists of the query's shingles are divided: as many of the longest as the
    threshold T allows are set aside, the short ones are merged by a heap, and texts that occur
    often enough in them are looked up in the long lists by binary search.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    words, ends = keys[first], np.r_[first[1:], len(keys)]
    for q, found in enumerate(queries):
        at = np.searchsorted(words, found)
        inside = at < len(words)
        at = at[inside]
        at = at[words[at] == found[inside]]
        least = ceil_share(len(found), percent)
        if not len(found) or len(at) < least:
            continue
        length = ends[at] - first[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(ends[at[-1]] - first[at[-1]])
        n_long = min(least - 1, int(least / (0.02 * np.log2(longest + 1) + 1)))
        short, long = at[:len(at) - n_long], at[len(at) - n_long:]
        candidates, counts = [], []
        last, count = -1, 0
        for text in heapq.merge(*[owner[first[x]:ends[x]].tolist() for x in short]):
            if text == last:
                count += 1
                continue
            if count >= least - n_long:
                candidates.append(last)
                counts.append(count)
            last, count = text, 1
        if count >= least - n_long:
            candidates.append(last)
            counts.append(count)
        texts, overlap = np.array(candidates, np.int64), np.array(counts, np.int64)
        near = (sizes[texts] * 100 >= len(found) * percent) & (sizes[texts] * percent <= len(found) * 100)
        texts, overlap = texts[near], overlap[near]
        for x in long:
            have = owner[first[x]:ends[x]]
            place = np.searchsorted(have, texts)
            overlap += (place < len(have)) & (have[np.minimum(place, len(have) - 1)] == texts)
        if len(texts):
            yield q, texts, overlap


def search_cell(percent: int) -> Callable:
    """Links inside one cell: each linked class with a root of its part and how many texts it links to."""
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        # Blocks of a group may be empty: the other one has its own cell for the links inside it.
        if table.column("crosses")[0].as_py() and len(np.unique(side)) < 2:
            return table.select(["cls", "cls", "copies"]).slice(0, 0).rename_columns(["cls", "root", "links"])
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        raw = table.column("shingles").to_pylist()
        _, once = np.unique(np.stack([side, cls], 1), axis=0, return_index=True) if len(cls) else (None, np.zeros(0, np.int64))
        sides = [[i for i in once if side[i] == s] for s in (0, 1)]
        sets = {i: np.frombuffer(raw[i], np.uint64) for i in once}
        crossed = bool(sides[1])
        other = sides[1] if crossed else sides[0]
        parent = {i: i for i in once}
        links = dict.fromkeys(once, 0)

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for q, texts, overlap in divide_skip([sets[i] for i in sides[0]], [sets[i] for i in other], percent):
            i = sides[0][q]
            union = len(sets[i]) + np.array([len(sets[other[t]]) for t in texts]) - overlap
            for t in texts[overlap * 100 >= union * percent]:
                j = other[t]
                if cls[i] == cls[j]:
                    continue
                links[i] += int(copies[j])
                if crossed:
                    links[j] += int(copies[i])
                a, b = sorted((root(i), root(j)), key=lambda x: cls[x])
                parent[b] = a
        found = [i for i in once if links[i]]
        return pa.table({
            "cls": pa.array([int(cls[i]) for i in found], pa.int64()), "root": pa.array([int(cls[root(i)]) for i in found], pa.int64()),
            "links": pa.array([links[i] for i in found], pa.int64()),
        })
    return run


def jaccard_classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, n_links) of every row: the classes that similar texts form.

    Words are lower-cased (A-Z) runs outside ``[\\x20\\x09-\\x0D]``; a text's set has its distinct
    ``shingle``-word shingles, or its whole sequence where it has fewer words.  Two texts link when
    100 * intersection >= percent * union; component_id is the least key that links lead to, and
    n_links the number of other rows a row links to (equal sets link, too).  The result is exact up
    to collisions of 64-bit hashes.

    1. Texts of equal sets fold into a class.
    2. T-occurrence bound on prefixes: two similar texts share several of their least hashes.
       Prefix postings meet by hash; a class with too few shared ones is done.
    3. Over the rest all postings meet by hash, which gives the lengths of all inverted lists.
       Each text keeps the shortest n - T + 1 of its lists; lists tie candidates together.
    4. Groups of candidates are searched by DivideSkip, large ones as pairs of bounded blocks,
       so that no task holds more than two blocks and no pairs are emitted.

    Copies fold before postings move; a list is a sorted array inside a bucket whose number follows
    the postings.  A group that is not one class of equal sets costs the square of its blocks.

    A null or wordless text has no shingles, links with nothing and is its own component.  Rows
    with a null key take part but never name a component.  Repeated rows are copies.  An empty
    table gives an empty result.  Other columns are ignored, whatever their names.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    key_type = docs.schema["_key"].dataType.simpleString()

    signed = scratch.keep(docs.mapInArrow(signatures(shingle), f"_key {key_type}, cls long, n int"))
    classes = scratch.keep(signed.where("n > 0").groupBy("cls", "n").agg(F.min("_key").alias("rep"), F.count("*").alias("copies")))
    total = classes.agg(F.sum("n")).first()[0] or 0

    def buckets(postings: int) -> int:
        return max(tasks(spark), postings // SORT_POSTINGS + 1)

    wide = buckets(total * (100 - percent + SPARE) // 100)
    hits = (
        docs.mapInArrow(prefixes(shingle, percent, wide), BLOB).repartitionById(wide, F.col("bucket"))
        .mapInArrow(shared_counts, "cls long, hits long").groupBy("cls").agg(F.sum("hits").alias("hits"))
    )
    # A partner may be smaller and then vouches for fewer shared prefix entries.
    smallest = F.ceil(F.col("n") * percent / 100)
    needed = F.greatest(F.lit(1), F.least(F.floor(smallest * SPARE / 100), F.ceil(smallest * percent / 100)))
    survivors = scratch.keep(classes.join(hits, "cls").where(F.col("hits") >= needed).select("cls", "n", "rep", "copies"))

    left = survivors.select(F.col("rep").alias("_rep"), "cls", "copies")
    if survivors.count() <= MAX_BROADCAST:
        left = F.broadcast(left)
    sets = scratch.keep(
        docs.join(left, F.col("_key").eqNullSafe(F.col("_rep"))).select("_text", "cls", "copies")
        .mapInArrow(survivor_sets(shingle), "cls long, n int, copies long, shingles binary")
    )
    narrow = buckets(sets.agg(F.sum("n")).first()[0] or 0)
    ties = (
        sets.mapInArrow(all_postings(narrow), BLOB).repartitionById(narrow, F.col("bucket"))
        .mapInArrow(shared_keys(narrow), "part int, docs binary, ns binary, keys binary, texts binary").repartitionById(narrow, F.col("part"))
        .mapInArrow(rare_prefixes(percent, narrow), BLOB).repartitionById(narrow, F.col("bucket"))
        .mapInArrow(stars, "a long, b long")
    )
    groups = connected_components(ties, scratch)

    members = scratch.keep(groups.withColumnRenamed("node", "cls").join(survivors.select("cls", "n"), "cls"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root")
    small = max(1, members.count() // (BLOCK_TEXTS // 2))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    cells = sized.withColumn("own", own).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "cls",
        F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(small))))
        .otherwise(F.concat_ws(":", F.col("root"), F.least("own", "with"), F.greatest("own", "with"))).alias("cell"),
        (F.col("own") > F.col("with")).cast("int").alias("side"), (F.col("own") != F.col("with")).alias("crosses"),
    )
    linked = scratch.keep(
        cells.join(sets, "cls").select("cell", "side", "crosses", "cls", "copies", "shingles")
        .groupBy("cell").applyInArrow(search_cell(percent), "cls long, root long, links long")
    )
    parts = connected_components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))

    labelled = (
        classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left")
        .select("cls", "n", "rep", "copies", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = labelled.join(least, "root").select("cls", "n", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = scratch.keep(
        signed.join(named, ["cls", "n"], "left").select(
            F.col("_key").alias(key), F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("_key")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )
    scratch.keep_only(out)
    return out
