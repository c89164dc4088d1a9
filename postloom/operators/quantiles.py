"""Exact quantiles of several columns at once, without a sort and without a value table in one task.

Doubles are mapped to 64-bit numbers of the same order.  Each round counts, for every wanted rank of every
column, the rows whose number begins with the bits known so far, by the next sixteen bits; the counter that
holds the rank gives sixteen more bits.  Four rounds give every bit.  A round is one pass with partial
sums; what comes out is at most 65 536 counters per wanted rank, and only those around a rank reach the
driver: one row per rank.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from postloom.operators.lineage import stored

DIGIT = 16  # bits that a round finds


@F.arrow_udf(LongType())
def ordered_bits(numbers: pa.Array) -> pa.Array:
    """Doubles as longs of the same order: NaN is the greatest, both zeros are one; null stays null."""
    values = numbers.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    values = np.where(np.isnan(values), np.nan, values)  # one NaN of all
    bits = values.view(np.int64)
    out = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pa.array(out, mask=np.asarray(numbers.is_null()))


def from_bits(bits: int) -> float:
    """The double of a long that ``ordered_bits`` made."""
    value = np.array([bits], np.int64)
    return float(np.where(value < 0, value ^ np.int64(0x7FFFFFFFFFFFFFFF), value).view(np.float64)[0])


def ordered_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bits) of all values that are not null, by the number of the column; stored, so that ``df`` is read once."""
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), ordered_bits(F.col(f"`{c}`").cast("double")).alias("bits")) for i, c in enumerate(columns)])
    return stored(df.select(F.inline(pairs)).where("bits is not null"))


def select_ranks(values: DataFrame, ranks: dict[int, list[int]]) -> dict[int, dict[int, float]]:
    """For every column of ``ordered_values`` the values at the given ranks (from 0) in ascending order."""
    spark = values.sparkSession
    # Per wanted rank: the bits found so far, and its rank among the rows that begin with them.
    found = [(i, rank, 0, rank) for i, wanted in ranks.items() for rank in sorted(set(wanted))]
    for shift in range(64 - DIGIT, -1, -DIGIT) if found else ():
        known = spark.createDataFrame(sorted({(i, prefix) for i, _, prefix, _ in found}), "column int, prefix long")  # at most a row per rank
        counts = counted(values, known, shift)
        wanted = spark.createDataFrame([(n, i, prefix, left) for n, (i, _, prefix, left) in enumerate(found)], "n int, column int, prefix long, left long")
        before = Window.partitionBy("column", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        summed = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        hits = summed.join(F.broadcast(wanted), ["column", "prefix"]).where("left >= before and left < before + rows").select("n", "digit", "before").collect()
        at = {r.n: r for r in hits}
        found = [(i, rank, prefix << DIGIT | at[n].digit, left - at[n].before) for n, (i, rank, prefix, left) in enumerate(found)]
    out = {i: {} for i in ranks}
    for i, rank, bits, _ in found:
        out[i][rank] = from_bits(bits - (1 << 63))
    return out


def counted(values: DataFrame, known: DataFrame, shift: int) -> DataFrame:
    """(column, prefix, digit, rows): of every known prefix, the rows by their next digit."""
    # The sign bit is turned, so that numbers without sign have the same order and shifts bring in zeros.
    plain = F.col("bits").bitwiseXOR(F.lit(-(1 << 63)))
    high = F.shiftrightunsigned(plain, shift + DIGIT) if shift + DIGIT < 64 else F.lit(0)
    digit = F.shiftrightunsigned(plain, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
    rows = values.select("column", high.cast("long").alias("prefix"), digit.cast("int").alias("digit"))
    return rows.join(F.broadcast(known), ["column", "prefix"]).groupBy("column", "prefix", "digit").agg(F.count(F.lit(1)).alias("rows"))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Per column the quantiles at ``shares``, interpolated between neighbouring values; None without values."""
    values = ordered_values(df, columns)
    counts = {r["column"]: r["count"] for r in values.groupBy("column").count().collect()}  # a row per column
    places = {c: [(counts[i] - 1) * s for s in shares] if i in counts else [] for i, c in enumerate(columns)}
    found = select_ranks(values, {i: [r for p in places[c] for r in (math.floor(p), math.ceil(p))] for i, c in enumerate(columns)})
    at = {c: found[i] for i, c in enumerate(columns)}
    out = {}
    for c, ps in places.items():
        ends = [(at[c][math.floor(p)], at[c][math.ceil(p)], p) for p in ps]
        out[c] = [a if a == b or p == int(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for a, b, p in ends] or [None] * len(shares)
    return out
