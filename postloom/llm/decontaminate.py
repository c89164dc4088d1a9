"""Benchmark decontamination: MinHash containment search by size class, then exact containment."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch
from postloom.llm.wordhash import SHINGLE, mix, shingle_lists

#: MinHash functions of an item, by size class (class c: up to 2 ** c shingles); below 2 ** 6 all shingles are in the sketch.
SKETCH = 64
#: Chance that an item at the threshold is missed, from which each class gets its least number of hits.
MISS = 1e-9
#: The two filters of shingle hashes have at most so many bits (16 MB each), whatever the benchmark's size.
MAX_BITS = 1 << 27
BITS_PER_HASH = 64


def plain(column: pa.Array) -> pa.Array:
    """Lower case, with every ASCII sign other than letters and digits turned into a space."""
    return pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ")


def size_class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The shingles that are least under SKETCH hash functions; all of them for small sets."""
    if len(shingles) <= SKETCH:
        return np.unique(shingles)
    ways = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    return np.unique([shingles[np.argmin(mix(shingles ^ w))] for w in ways])


def least_hits(size: int, percent: int) -> int:
    """Hits that a contained item has in its sketch but with chance MISS.

    A small item's sketch is its whole set, where the threshold itself holds.  Otherwise a text
    that holds ``percent`` of the item's shingles holds each sampled one with that chance.
    """
    if size <= SKETCH:
        return -(-size * percent // 100)
    share, below = percent / 100, 0.0
    for hits in range(SKETCH + 1):
        below += comb(SKETCH, hits) * share ** hits * (1 - share) ** (SKETCH - hits)
        if below > MISS:
            # Several functions may pick one shingle: distinct hits are rarer than hits.
            return max(1, hits // 2)
    return 1


def _item_rows(shingle: int, percent: int) -> Callable:
    def run(batches):
        for batch in batches:
            out: list = [[], [], [], [], [], [], []]
            keys, texts = batch.column("_item").to_pylist(), plain(batch.column("_text"))
            for i, found in shingle_lists(texts, shingle):
                every = np.unique(found)
                if not len(every):
                    continue
                chosen = np.isin(every, sketch(every))
                out[0] += every.view(np.int64).tolist()
                out[1] += chosen.tolist()
                words = min(shingle, sum(w != "" for w in texts[i].as_py().split(" ")))
                for j, x in ((2, keys[i]), (3, len(every)), (4, size_class(len(every))), (5, least_hits(len(every), percent)), (6, words)):
                    out[j] += [x] * len(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], batch.column("_item").type),
                 *[pa.array(x, pa.int32()) for x in out[3:]]],
                ["hash", "in_sketch", "_item", "n_item", "size_class", "least", "words"],
            )
    return run


def _bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes, of ``bits`` bits, put together from 64-bit words."""
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = hashes.select(
        F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"),
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _text_rows(shingle: int, shorter: tuple[int, ...], shared) -> Callable:
    def run(batches):
        sketched, listed = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows, hashes = [], []
                for i, found in shingle_lists(plain(part.column("_text")), shingle, shorter):
                    # Only a text that meets some sketch is searched for the rest of the items.
                    if len(found) and _passes(sketched, found).any():
                        some = np.unique(found[_passes(listed, found)])
                        rows.append(np.full(len(some), i))
                        hashes.append(some)
                if rows:
                    keys = part.column("_doc").take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(hashes).view(np.int64))], ["_doc", "hash"])
    return run


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    shingle: int = SHINGLE, percent: int = 75, short_items: bool = False,
) -> DataFrame:
    """(key, item_key, n_item, n_shared, containment): texts that hold an item's shingles.

    Words are runs of letters and digits of the lower-cased text.  An item is held where
    100 * shared >= percent * its distinct ``shingle``-word shingles (an item of fewer words is one
    shingle, its sequence, and is found only in texts that equal it).  With ``short_items`` an item of
    fewer words is found wherever a text has its words in a row: texts then have the runs of those
    lengths that items have, too (at most ``shingle`` - 1), behind the same bitmaps.

    Items are split by size class; every item has a MinHash sketch (small ones: all shingles) and,
    by class, a number of sketch hits that a holding text reaches with a chance of 1 - MISS.
    Texts of any length meet the sketches through a bitmap of bounded size; texts without a hit
    end there.  Of the others, shingles that some item may have are joined with the items' hashes:
    candidates are (text, item) pairs with enough sketch hits, and exact counts verify them.

    Equal item texts are searched once and reported for each item key.  Null or wordless texts and
    items hold nothing; rows with a null key are left out; repeated rows count once; empty tables
    give an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    named = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("_id"), F.col(item_text).alias("_text"))
    groups = named.select("_text").distinct().select(F.xxhash64("_text").alias("_item"), "_text")
    rows = scratch.keep(groups.mapInArrow(
        _item_rows(shingle, percent), "hash long, in_sketch boolean, _item long, n_item int, size_class int, least int, words int"))
    shorter = tuple(sorted(r[0] for r in rows.where(F.col("words") < shingle).select("words").distinct().collect())) if short_items else ()
    bits = 1 << 12
    while bits < rows.count() * BITS_PER_HASH and bits < MAX_BITS:
        bits *= 2
    shared = spark.sparkContext.broadcast((_bits(rows.where("in_sketch"), bits), _bits(rows, bits)))

    work = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    doc_type = work.schema["_doc"].dataType.simpleString()
    met = work.mapInArrow(_text_rows(shingle, shorter, shared), f"_doc {doc_type}, hash long").dropDuplicates()
    pairs = met.join(rows, "hash").groupBy("_doc", "_item").agg(
        F.count("*").alias("n_shared"), F.count_if("in_sketch").alias("hits"), F.max("n_item").alias("n_item"), F.max("least").alias("least"),
    ).where("hits >= least").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    ids = named.select("_id", F.xxhash64("_text").alias("_item")).distinct()
    return pairs.join(ids, "_item").groupBy(F.col("_doc").alias(key), F.col("_id").alias(item_key)).agg(
        F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item")).alias("best"),
    ).select(
        key, item_key, F.col("best.n_item").cast("long").alias("n_item"), F.col("best.n_shared").alias("n_shared"),
        (F.col("best.n_shared") / F.col("best.n_item")).alias("containment"),
    )
