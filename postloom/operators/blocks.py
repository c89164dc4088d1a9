"""Splitting large groups into blocks of bounded size.

Pairwise work inside a group (neighbours, total distances) is quadratic and one group may
hold a large share of all rows.  Rows are therefore spread over blocks by the hash of their
key and the work is done per pair of blocks; no task ever holds more than two blocks.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.bounded import bounded_table

BLOCK_ROWS = 50_000
LEAST_BLOCK_ROWS = 500


def crowded_groups(block_rows: int, by: list[str], **sides: DataFrame) -> dict[str, DataFrame | None]:
    """For each named table (by..., _<name>_blocks): the number of blocks of the groups that
    need more than one; None where no group does.

    All tables are counted in one job that reads the group columns only.
    """
    tagged = None
    for name, df in sides.items():
        part = df.select(*by, F.lit(name).alias("_side"))
        tagged = part if tagged is None else tagged.unionByName(part)
    sizes = (
        tagged.groupBy(*by, "_side").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > block_rows)
        .withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("int"))
        .drop("_n")
    )
    table = bounded_table(sizes)
    crowded = list(sides) if table is None else table["_side"].to_pylist()

    def of(name):
        if name not in crowded:
            return None
        if table is None:  # too many crowded groups to broadcast: joined by shuffle
            found = sizes
        else:
            found = F.broadcast(sizes.sparkSession.createDataFrame(table, sizes.schema))
        found = found.where(F.col("_side") == name)
        return found.select(*by, F.col("_blocks").alias(f"_{name}_blocks"))

    return {name: of(name) for name in sides}


def spread_blocks(df: DataFrame, block_rows: int) -> int:
    """Rows per block with which the pairs of blocks of one table keep all cores busy."""
    side = math.ceil(math.sqrt(df.sparkSession.sparkContext.defaultParallelism))
    return max(min(block_rows, LEAST_BLOCK_ROWS), min(block_rows, math.ceil(df.count() / side)))


def with_block_count(df: DataFrame, crowded: DataFrame | None, by: list[str], name: str) -> DataFrame:
    if crowded is None:
        return df.withColumn(name, F.lit(1))
    # Aliases: the same counts may be joined to both sides of a later join.
    fresh = crowded.select(*[F.col(c).alias(c) for c in crowded.columns])
    return df.join(fresh, by, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def own_block(key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")


def every_block(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
