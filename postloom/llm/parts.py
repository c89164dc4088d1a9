"""Tables cut into parts along a sort order, for running values over groups of any size.

A window over a group needs the whole group in one task.  Here the table is dealt out by ranges of
(group, order), so that a group of any size is cut into parts of about the same number of rows; windows
run per part and group, and what earlier parts hold is carried over.  Only the first and the last group
of a part can reach into another one, so the carried table has at most two rows per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch, tasks


def sorted_parts(df: DataFrame, group: list[str], order: list[str | Column], scratch: Scratch) -> DataFrame:
    """``df`` with its part in ``_part``, written once so that the cut is the same for every reader."""
    parts = df.repartitionByRange(tasks(df.sparkSession), *group, *order)
    return scratch.keep(parts.withColumn("_part", F.spark_partition_id()))


def in_part(group: list[str], order: list[str | Column]):
    """The window over one group's rows in one part."""
    return Window.partitionBy("_part", *group).orderBy(*order)


def spanning(parts: DataFrame, group: list[str], *aggregates: Column) -> DataFrame:
    """(_part, group..., aggregates...) of the groups that reach over several parts.

    At most two rows per part, since such a group is the first or the last one of each of its parts:
    small enough to be broadcast, by construction.
    """
    ends = parts.groupBy("_part").agg(F.min(F.struct(*group)).alias("low"), F.max(F.struct(*group)).alias("high"))
    several = (
        ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("_group"))
        .groupBy("_group").agg(F.count("*").alias("n")).where("n > 1").select("_group.*")
    )
    return parts.join(F.broadcast(several), group).groupBy("_part", *group).agg(*aggregates)


def earlier_parts(group: list[str]):
    """The window over the rows that ``spanning`` has of a group's earlier parts."""
    return Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_carried(parts: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    """``parts`` with the columns of ``carried``, a table made from ``spanning``; null for other groups."""
    return parts.join(F.broadcast(carried), ["_part", *group], "left")
