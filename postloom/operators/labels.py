"""Label vocabularies."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from postloom.operators.bounded import MAX_BROADCAST_ROWS, bounded_table, broadcast_if_small
from postloom.operators.lineage import cut_lineage


def label_vocabulary(df: DataFrame, column: str, max_labels: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(label, index): the sorted distinct labels, numbered from 0.

    Up to ``max_labels`` labels are numbered as a local table.  More are cut into ranges, which
    are numbered side by side and shifted by the number of labels before them; only one count
    per range passes through a single task.
    """
    distinct = df.select(F.col(column).alias("label")).where("label is not null").distinct()
    known = bounded_table(distinct, max_labels)
    if known is not None:
        known = known.sort_by("label").append_column("index", pa.array(range(known.num_rows), pa.int32()))
        kind = StructType([*distinct.schema.fields, StructField("index", IntegerType())])
        return df.sparkSession.createDataFrame(known, kind)
    # Stored, so that the ranges stay as they were when they were counted.
    parts = cut_lineage(distinct.repartitionByRange("label").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("_range").orderBy("label")
    return parts.join(offsets, "_range").select(
        "label", (F.col("_offset") + F.row_number().over(within) - 1).cast("int").alias("index")
    )


def label_encode(df: DataFrame, column: str, vocabulary: DataFrame, name: str | None = None) -> DataFrame:
    """Replace (or add as ``name``) a label by its index; a label not in the vocabulary fails."""
    known = broadcast_if_small(
        vocabulary.select(F.col("label").alias(column), F.col("index").alias("_index"))
    )
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(column).cast("string")))
    index = F.when(F.col(column).isNotNull(), F.coalesce("_index", unseen.cast("int")))
    return df.join(known, column, "left").withColumn(name or column, index).drop("_index")


def label_decode(df: DataFrame, column: str, vocabulary: DataFrame, name: str = "label") -> DataFrame:
    """Add the label that belongs to an index."""
    known = broadcast_if_small(
        vocabulary.select(F.col("index").alias(column), F.col("label").alias(name))
    )
    return df.join(known, column, "left")
