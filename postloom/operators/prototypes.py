"""Prototype and centroid tables, search in them, and prototype scoring."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from postloom.functions.vectors import finite
from postloom.operators.bounded import bounded_rows
from postloom.operators.cluster import nearest_centroid, normalize_vectors
from postloom.operators.knn import TILE_CELLS, exact_sq_dist, knn_join, to_matrix
from postloom.operators.representatives import group_mean, representative

MAX_PROTOTYPES = 5_000


def cluster_prototypes(df: DataFrame, type: str = "centroid", vec: str = "v", key: str = "vec_id") -> DataFrame:
    """(cluster, subcategory, proto, n): one representative per label and cluster."""
    found = representative(df, ["cluster", "subcategory"], vec, type, key)
    return found.withColumnRenamed("representative", "proto")


def cluster_centroids(df: DataFrame, type: str = "centroid", vec: str = "v", key: str = "vec_id") -> DataFrame:
    """(cluster, centroid, n): one representative per cluster, from all its rows."""
    return representative(df, "cluster", vec, type, key).withColumnRenamed("representative", "centroid")


def search_prototypes(
    queries: DataFrame, prototypes: DataFrame, k: int = 1, vec: str = "v", key: str = "vec_id"
) -> DataFrame:
    """(cluster, query_id, rank, subcategory, sq_dist): nearest prototypes of the query's cluster."""
    base = prototypes.select("cluster", F.col("subcategory").alias(key), F.col("proto").alias(vec))
    near = knn_join(queries, base, k=k, by="cluster", key=key, vec=vec, carry=())
    return near.withColumnRenamed("neighbor_id", "subcategory")


def routed_search(
    queries: DataFrame, prototypes: DataFrame, centroids: DataFrame, k: int = 1, vec: str = "v", key: str = "vec_id"
) -> DataFrame:
    """(cluster, query_id, rank, subcategory, sq_dist): the way through a stored index.

    A query goes to its nearest stored centroid and meets the prototypes of that cluster only;
    of a table in folders by cluster, only the folders that some query goes to are read.
    """
    routed = nearest_centroid(queries.drop("cluster"), centroids, vec, key)
    visited = bounded_rows(routed.select("cluster").where("cluster is not null").distinct())
    if visited is not None:
        prototypes = prototypes.where(F.col("cluster").isin([r["cluster"] for r in visited]))
    return search_prototypes(routed, prototypes, k, vec, key)


def label_prototypes(support: DataFrame, label: str = "subcategory", vec: str = "v") -> DataFrame:
    """(label, proto): mean of the normalised support vectors; the mean is not re-normalised."""
    means = group_mean(normalize_vectors(support.where(finite(F.col(vec))).select(label, vec), vec), label, vec)
    return means.select(F.col(label).alias("label"), F.col("representative").alias("proto"))


def prototype_scores(
    queries: DataFrame,
    prototypes: DataFrame,
    vec: str = "v",
    keep: Sequence[str] = ("vec_id",),
    max_prototypes: int = MAX_PROTOTYPES,
) -> DataFrame:
    """(keep..., label, score): minus the Euclidean distance of every query to every prototype.

    The full score matrix is the result.  Up to ``max_prototypes`` prototypes are sent to
    every task and add one array of scores per query; more are scored block by block.  The
    first of ``keep`` is the key of the queries.
    """
    keep = list(keep)
    rows = bounded_rows(prototypes.select("label", "proto"), max_prototypes)
    unit = normalize_vectors(queries.where(finite(F.col(vec))).select(*keep, vec), vec)
    if rows is None:
        base = prototypes.select(F.col("label").alias(keep[0]), F.col("proto").alias(vec))
        ranked = knn_join(unit, base, k=prototypes.count(), by=None, key=keep[0], vec=vec, carry=())
        scored = ranked.select(
            F.col("query_id").alias(keep[0]), F.col("neighbor_id").alias("label"), (-F.sqrt("sq_dist")).alias("score")
        )
        return scored if len(keep) == 1 else unit.select(*keep).join(scored, keep[0])
    rows.sort(key=lambda r: r["label"])
    labels = [r["label"] for r in rows]
    protos = np.array([r["proto"] for r in rows], dtype=np.float64)

    @F.arrow_udf(ArrayType(DoubleType()))
    def scores(vectors: pa.Array) -> pa.Array:
        matrix = to_matrix(vectors)
        n, p = len(matrix), len(protos)
        dist, step = np.empty(n * p), max(1, TILE_CELLS // p)
        for start in range(0, n, step):
            tile = matrix[start:start + step]
            at, near = np.repeat(np.arange(len(tile)), p), np.tile(np.arange(p), len(tile))
            dist[start * p:(start + len(tile)) * p] = -np.sqrt(exact_sq_dist(tile, protos, at, near))
        return pa.ListArray.from_arrays(np.arange(0, n * p + 1, p, dtype=np.int32), pa.array(dist))

    named = F.arrays_zip(F.lit(labels).alias("label"), scores(F.col(vec)).alias("score"))
    return unit.select(*keep, F.inline(named))


def prototypical_classify(
    support: DataFrame, queries: DataFrame, label: str = "subcategory", vec: str = "v", key: str = "vec_id"
) -> DataFrame:
    """(query_id, prediction, score): the label with the highest prototype score per query.

    The best score is the nearest prototype, so this is a 1-nearest-neighbour join and works
    for any number of labels; ties go to the lowest label.
    """
    base = label_prototypes(support, label, vec).select(F.col("label").alias(key), F.col("proto").alias(vec))
    unit = normalize_vectors(queries.where(finite(F.col(vec))).select(key, vec), vec)
    near = knn_join(unit, base, k=1, by=None, key=key, vec=vec, carry=())
    return near.select(
        "query_id", F.col("neighbor_id").alias("prediction"), (-F.sqrt("sq_dist")).alias("score")
    )
