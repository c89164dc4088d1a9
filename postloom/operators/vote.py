"""Votes over the nearest neighbours of each query."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.vectors import inverse_distance_weight


def _vote(neighbors: DataFrame, label: str, query_id: str, weight: Column) -> DataFrame:
    # Partitioning by the query serves both aggregations with one shuffle.
    tallies = (
        neighbors.repartition(query_id)
        .groupBy(query_id, label)
        .agg(F.sum(weight).alias("_votes"), F.min("rank").alias("_first"))
    )
    # The winner's label must not take part in the order: ties go to the nearest neighbour.
    best = F.max_by(F.struct(F.col(label), F.col("_votes")), F.struct("_votes", -F.col("_first")))
    return tallies.groupBy(query_id).agg(best.alias("_best")).select(
        query_id,
        F.col(f"_best.{label}").alias("prediction"),
        F.col("_best._votes").alias("votes"),
    )


def vote_weighted(neighbors: DataFrame, label: str = "subcategory", query_id: str = "query_id") -> DataFrame:
    """The label with the largest sum of inverse squared distances."""
    return _vote(neighbors, label, query_id, inverse_distance_weight(F.col("sq_dist")))


def vote_majority(neighbors: DataFrame, label: str = "subcategory", query_id: str = "query_id") -> DataFrame:
    """The most frequent label."""
    return _vote(neighbors, label, query_id, F.lit(1))
