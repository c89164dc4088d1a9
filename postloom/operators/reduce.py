"""Neighbour graph, fuzzy graph and a graph-smoothed embedding.

The graph follows the definition of UMAP (McInnes, Healy and Melville, 2018): local
scaling by the nearest distance and a bandwidth that fixes the effective neighbourhood
size, then the probabilistic union of both directions.  The stochastic layout is replaced
by repeated averaging of PCA coordinates over the graph.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from postloom.operators.descent import descend
from postloom.operators.knn import knn_join
from postloom.operators.lineage import cut_lineage
from postloom.operators.pruned import knn_join_pruned

N_NEIGHBORS = 27  # fixed value: the default workload parameter
BISECTIONS = 64
MAX_SUMS = 96  # components that are summed one by one: Spark generates no code for rows of more than 100 fields


def knn_graph(
    df: DataFrame,
    n_neighbors: int = N_NEIGHBORS,
    key: str = "vec_id",
    vec: str = "v",
    by: str | None = None,
    cells: int | None = None,
    method: str = "exact",
) -> DataFrame:
    """(src, dst, rank, dist): the nearest other rows of every row.

    ``method`` "exact": ``by`` limits the graph to groups, such as clusters; without it the search
    over the whole table is pruned (see ``pruned``), in ``cells`` parts.  Vectors without structure
    cannot be pruned and cost n² distances; "descent" bounds the distances per row instead (see
    ``descent``) and misses some neighbours: ``graph_recall`` tells how many.
    """
    if method == "descent":
        if by is not None:
            raise ValueError("descent is over the whole table")
        return descend(df, n_neighbors, key, vec).graph
    if method != "exact":
        raise ValueError(f"unknown method {method!r}; choose exact or descent")
    if by is None:
        near = knn_join_pruned(df, df, n_neighbors, key, vec, exclude_self=True, cells=cells)
    else:
        near = knn_join(df, df, k=n_neighbors, by=by, key=key, vec=vec, carry=(), exclude_self=True)
    return near.select(
        F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "rank", F.sqrt("sq_dist").alias("dist")
    )


def membership(distances: Column) -> Column:
    """Membership strengths of one row's neighbours, from the array of their distances.

    exp(-max(0, d - rho) / sigma), with rho the least positive distance and sigma such that
    the strengths sum to log2 of the number of neighbours.  All rows of a batch are solved
    together by bisection.
    """
    @F.arrow_udf(ArrayType(DoubleType()))
    def strengths(lists: pa.Array) -> pa.Array:
        sizes = np.array([len(d) for d in lists])
        present = np.arange(sizes.max(initial=1)) < sizes[:, None]
        dist = np.full(present.shape, np.inf)
        dist[present] = lists.flatten().to_numpy(zero_copy_only=False)
        rho = np.where(present & (dist > 0), dist, np.inf).min(axis=1)
        rho[~np.isfinite(rho)] = 0.0
        gap = np.maximum(dist - rho[:, None], 0.0)
        target = np.log2(np.maximum(sizes, 2))
        low, high = np.zeros(len(sizes)), np.full(len(sizes), np.inf)
        sigma = np.ones(len(sizes))
        for _ in range(BISECTIONS):
            over = np.exp(-gap / sigma[:, None]).sum(axis=1) > target
            high, low = np.where(over, sigma, high), np.where(over, low, sigma)
            sigma = np.where(np.isinf(high), sigma * 2.0, (low + high) / 2.0)
        mean = np.where(present, dist, 0.0).sum(axis=1) / np.maximum(sizes, 1)
        sigma = np.maximum(sigma, np.maximum(1e-3 * mean, 1e-12))
        weight = np.exp(-gap / sigma[:, None])[present]
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(weight))

    return strengths(distances)


def directed_weights(graph: DataFrame) -> DataFrame:
    """(src, dst, weight): membership strength of every edge, before both directions meet."""
    near = F.sort_array(F.collect_list(F.struct("dist", "dst")))
    return (
        graph.groupBy("src").agg(near.alias("_near"))
        .withColumn("_weight", membership(F.col("_near.dist")))
        .select("src", F.inline(F.arrays_zip(F.col("_near.dst").alias("dst"), F.col("_weight").alias("weight"))))
    )


def fuzzy_graph(graph: DataFrame) -> DataFrame:
    """(src, dst, weight): both directions united as a + b - a b.

    Every edge is emitted in both directions and the two strengths meet in one aggregation,
    which replaces a full outer self-join.
    """
    one = directed_weights(graph)
    # The directed weights are computed once: each edge becomes its two directions.
    sides = F.array(
        F.struct(F.col("src"), F.col("dst"), F.col("weight").alias("a"), F.lit(0.0).alias("b")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("a"), F.col("weight").alias("b")),
    )
    met = one.select(F.inline(sides)).groupBy("src", "dst").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return met.select("src", "dst", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def _weighted_mean(rows: DataFrame, by: str, width: int) -> DataFrame:
    """(by, _mean) of ``_coords`` of ``width`` components.

    A sum per component stays in flat rows: aggregates of vector objects are sorted and serialised
    once there are more than a few groups in a task.  Only very wide vectors go that way.
    """
    if not 0 < width <= MAX_SUMS:
        mean = Summarizer.metrics("mean").summary(array_to_vector("_coords"), F.col("weight"))
        return rows.groupBy(by).agg(vector_to_array(mean["mean"]).alias("_mean"))
    sums = [F.sum(F.col("weight") * F.col("_coords")[i]).alias(f"_{i}") for i in range(width)]
    total = rows.groupBy(by).agg(F.sum("weight").alias("_weight"), *sums)
    return total.select(by, F.array(*[F.col(f"_{i}") / F.col("_weight") for i in range(width)]).alias("_mean"))


def graph_embed(
    coords: DataFrame,
    edges: DataFrame,
    iterations: int = 5,
    step: float = 0.5,
    key: str = "vec_id",
    name: str = "reduced",
) -> DataFrame:
    """Move every point ``step`` of the way to the weighted mean of its graph neighbours,
    ``iterations`` times.

    ``coords`` holds the key and starting coordinates (PCA), ``edges`` a fuzzy graph.
    Every iteration is checkpointed: the plan stays small and a lost executor costs one
    iteration at most.
    """
    edges = cut_lineage(edges)
    points = cut_lineage(coords.select(key, F.col(name).cast("array<double>").alias("_coords")))
    width = points.agg(F.max(F.size("_coords"))).first()[0] or 0
    blend = F.zip_with(
        "_coords", "_mean", lambda own, mean: own * F.lit(1.0 - step) + mean * F.lit(step)
    )
    for _ in range(iterations):
        sent = edges.join(points.withColumnRenamed(key, "src"), "src")
        moved = _weighted_mean(sent, "dst", width).withColumnRenamed("dst", key)
        points = cut_lineage(
            points.join(moved, key, "left").select(
                key, F.when(F.col("_mean").isNull(), F.col("_coords")).otherwise(blend).alias("_coords")
            )
        )
    return points.withColumnRenamed("_coords", name)


def graph_transform(
    new: DataFrame,
    base: DataFrame,
    n_neighbors: int = N_NEIGHBORS,
    key: str = "vec_id",
    vec: str = "v",
    name: str = "reduced",
) -> DataFrame:
    """(key, name): new points at the weighted mean of their neighbours' coordinates.

    ``base`` holds the key, the original vector and the embedded coordinates.
    """
    # Coordinates are wide: links move with a short name of theirs, and only the nearest fetch them.
    base = base.select(key, vec, F.col(name).cast("array<double>").alias("_coords")).withColumn("_place", F.xxhash64("_coords"))
    near = knn_join_pruned(new, base, n_neighbors, key, vec, carry=("_place",))
    packed = F.sort_array(F.collect_list(F.struct(F.sqrt("sq_dist").alias("dist"), "neighbor_id", "_place")))
    links = (
        near.groupBy("query_id").agg(packed.alias("_near"))
        .withColumn("_weight", membership(F.col("_near.dist")))
        .select("query_id", F.inline(F.arrays_zip(F.col("_near.neighbor_id").alias("_id"), F.col("_near._place").alias("_at"), F.col("_weight").alias("weight"))))
    )
    coords = base.groupBy(F.col(key).alias("_key"), "_place").agg(F.first("_coords").alias("_coords"))
    sent = links.join(coords, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_place")))
    width = base.agg(F.max(F.size("_coords"))).first()[0] or 0
    return _weighted_mean(sent, "query_id", width).select(F.col("query_id").alias(key), F.col("_mean").alias(name))
