"""Broadcasting behind a check of the size, and dense ids without a global sort."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.hashing import hash_text

MAX_BROADCAST_ROWS = 100_000


def bounded_table(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> pa.Table | None:
    """``df`` as an Arrow table if it has at most ``max_rows`` rows, else None.

    Reads at most ``max_rows + 1`` rows to the driver.
    """
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def bounded_rows(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> list[dict] | None:
    """The same as a list of rows."""
    table = bounded_table(df, max_rows)
    return None if table is None else table.to_pylist()


def local_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` as a local table and True if it is within the bound, else ``df`` and False."""
    table = bounded_table(df, max_rows)
    if table is None:
        return df, False
    return df.sparkSession.createDataFrame(table, df.schema), True


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast local table if its row count is within the bound.

    Aggregates have no usable size estimate at planning time, so without this the large
    side of the join would be shuffled before AQE learns that the small side is small.
    A table beyond the bound is returned as it is and is joined by shuffle, where AQE
    splits skewed partitions.
    """
    local, small = local_if_small(df, max_rows)
    return F.broadcast(local) if small else df


def dense_index(df: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """Number distinct keys ``start, start+1, ...`` in the order of their hash.

    Keys are ranked inside 65536 hash buckets and shifted by the bucket's offset, so no
    task sorts more than its own buckets.  Only the offsets (at most 65536 rows) pass
    through a single task.
    """
    digest = hash_text(F.col(key))
    hashed = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 4))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy("_digest", key)
    return (
        hashed.join(F.broadcast(offsets), "_bucket")  # 65536 rows at most, by construction
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1 + start)
        .drop("_digest", "_bucket", "_offset")
    )
