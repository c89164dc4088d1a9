"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets per size class, the unit of the two-level prefix sum.
SUBS = 256


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: list[float], share: float, ceiling: float) -> DataFrame:
    """(source, source_size) with the target each source gets.

    Sources in code point order, null last, take the weights in turn.  ``share`` times all sizes
    is dealt by weight; a source stops at ``ceiling`` times its size and its excess goes to the
    others by weight until none is above.  In ascending order of ceiling * size / weight the
    stopped sources come first, so one running sum finds where stopping ends.  The table has one
    row per source; its windows run in one task.
    """
    if not weights or any(w <= 0 for w in weights) or not 0 <= share <= ceiling:
        raise ValueError("weights must be positive and 0 <= share <= ceiling")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn(
        "place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1,
    ).withColumn("weight", F.element_at(cycle, F.col("place") % len(weights) + 1))
    stop = ranked.withColumn("stop", F.col("source_size") * F.lit(float(ceiling)))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = stop.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    ).withColumn("open", F.col("stop") > F.col("level") * F.col("weight"))
    # The level of the first source that is not stopped holds for all that follow it.
    found = level.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("stop") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)["level"])
    return found.select(
        "source", "source_size",
        F.when(F.col("final").isNull(), F.col("stop"))
        .otherwise(F.least("stop", F.col("final") * F.col("weight"))).alias("target"),
    )


def systematic_mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0,
    seed: str = "mix", subs: int = SUBS,
) -> DataFrame:
    """Every row of ``df`` with size, source_size, target and copies (how often the mix takes it).

    Within a source each document expects target / source_size copies.  Documents stand in order
    of size class, hash bucket, size and hash of the key; running sums of the expected copies,
    shifted by one offset per source, are cut at whole numbers, and a document is taken once for
    each boundary it crosses.  Standing by size keeps the taken words near the target.

    The running sum has two levels: sums per (source, size class, hash bucket), then rows within
    a bucket, so no task needs a whole source.  Offsets and order are hashes of seed, source and
    key: reruns agree under any partitioning.

    Nulls: a null text has size 0, a null source is a source of its own (last), a null key is
    hashed as ``~``.  Rows of size 0 take part with 0 words.  Repeated rows count each on its own.
    A source of size 0 has target 0 and 0 copies.  An empty table gives an empty result.  Input
    columns named like an added one (size, source_size, target, copies) are replaced.
    """
    names = ("size", "source_size", "target", "copies")
    kept = [c for c in df.columns if c not in names]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], word_count(F.col(text)).alias("_size")).withColumns({
        "_source": F.col(source),
        "_key": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("~")),
        "_class": F.floor(F.log2(F.col("_size") + 1.0) * 8).cast("int"),
        "_hash": F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("~")))),
    }).withColumn("_sub", F.conv(F.substring("_hash", 1, 6), 16, 10).cast("int") % subs)

    cells = rows.groupBy("_key", "_source", "_class", "_sub").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    totals = cells.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    targets = source_targets(totals, list(weights), share, ceiling).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~")).alias("_key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_each"),
        (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~")))), 1, 8), 16, 10)
         .cast("double") / F.lit(2.0 ** 32)).alias("_offset"),
    )
    line = Window.partitionBy("_key").orderBy("_class", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0)))
    bucket = ["_key", "_class", "_sub"]
    cell = starts.join(targets, "_key").select(*bucket, "_before", "source_size", "target", "_each", "_offset")
    # The join has the window's keys, so rows move once.
    within = Window.partitionBy(*bucket).orderBy("_size", "_hash")
    placed = rows.withColumn("_at", F.row_number().over(within)).join(cell, bucket)
    rank = F.col("_before") + F.col("_at")
    crossed = F.floor(rank * F.col("_each") + F.col("_offset")) - F.floor((rank - 1) * F.col("_each") + F.col("_offset"))
    return placed.select(
        *[F.col(f"`{c}`") for c in kept], F.col("_size").alias("size"), "source_size", "target",
        crossed.cast("int").alias("copies"),
    )
