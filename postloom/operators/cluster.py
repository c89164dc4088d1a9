"""Normalise, reduce and cluster vectors with Spark ML."""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from postloom.functions.vectors import finite
from postloom.operators.bounded import bounded_rows
from postloom.operators.graph_reducer import GraphReducer
from postloom.operators.knn import TILE_CELLS, knn_join, to_matrix

# The default workload parameters.
REDUCER_CONFIG = {"n_components": 50}
CLUSTER_CONFIG = {"n_clusters": 80, "max_iter": 300, "random_state": 42}
MAX_CENTROIDS = 10_000
FIT_ROWS = 50_000  # reduced vectors per partition while fitting
FIT_PARTITIONS = 8
INIT_STEPS = 5  # oversampling rounds of the initialisation


@dataclass
class ClusterModel:
    """A fitted reducer (normaliser, then PCA or the neighbour graph) and k-means, with the settings used."""

    reducer: PipelineModel
    kmeans: KMeansModel
    reducer_config: dict = field(default_factory=lambda: dict(REDUCER_CONFIG))
    cluster_config: dict = field(default_factory=lambda: dict(CLUSTER_CONFIG))


def as_ml_vector(df: DataFrame, vec: str = "v", name: str = "_vector") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(vec).cast("array<double>")))


def normalize_vectors(df: DataFrame, vec: str = "v", name: str | None = None) -> DataFrame:
    """L2-normalise an array column; zero vectors stay zero."""
    scaled = Normalizer(p=2.0, inputCol="_vector", outputCol="_unit").transform(as_ml_vector(df, vec))
    return scaled.withColumn(name or vec, vector_to_array("_unit")).drop("_vector", "_unit")


def fit_reducer(
    df: DataFrame,
    vec: str = "v",
    n_components: int = REDUCER_CONFIG["n_components"],
    method: str = "pca",
    key: str = "vec_id",
    **graph_options,
) -> PipelineModel:
    """Normaliser and a reducer.

    ``method`` "pca": executors sum a d x d Gram matrix; only that reaches the driver.  "graph": PCA coordinates
    averaged over the neighbour graph of the rows (``GraphReducer``, with its options); needs a unique ``key``.
    """
    if method == "graph":
        ready = as_ml_vector(df.where(finite(F.col(vec))).select(key, vec), vec)
        graph = GraphReducer(inputCol="_unit", outputCol="_reduced", keyCol=key, nComponents=n_components, **graph_options)
        return Pipeline(stages=[Normalizer(p=2.0, inputCol="_vector", outputCol="_unit"), graph]).fit(ready)
    if method != "pca" or graph_options:
        raise ValueError(f"method {method!r} with {sorted(graph_options)}; choose pca, or graph with options")
    ready = as_ml_vector(df.select(vec), vec)
    width = ready.select(F.size(vec)).first()
    if width is None:
        raise ValueError("no rows to fit")
    stages = [
        Normalizer(p=2.0, inputCol="_vector", outputCol="_unit"),
        PCA(k=min(n_components, width[0]), inputCol="_unit", outputCol="_reduced"),
    ]
    return Pipeline(stages=stages).fit(ready)


def reduce(df: DataFrame, reducer: PipelineModel, vec: str = "v", name: str = "reduced") -> DataFrame:
    """Add the low-dimensional coordinates as an array column."""
    out = reducer.transform(as_ml_vector(df, vec))
    return out.withColumn(name, vector_to_array("_reduced")).drop("_vector", "_unit", "_reduced")


def fit_clusters(
    train: DataFrame,
    key: str = "vec_id",
    vec: str = "v",
    n_clusters: int = CLUSTER_CONFIG["n_clusters"],
    max_iter: int = CLUSTER_CONFIG["max_iter"],
    seed: int = CLUSTER_CONFIG["random_state"],
    n_components: int = REDUCER_CONFIG["n_components"],
    partitions: int | None = None,
    method: str = "pca",
    **graph_options,
) -> ClusterModel:
    """Fit normaliser, reducer and k-means; ``predict_clusters`` on the same rows gives the labels.

    ``method`` and ``graph_options`` choose the reducer, see ``fit_reducer``.

    k-means depends on how rows are partitioned and ordered, so both are fixed: by the key
    and, unless ``partitions`` is given, the row count.  Initial centres come from the
    scalable k-means++ variant; each iteration moves k partial sums per partition.
    """
    usable = train.where(finite(F.col(vec))).select(key, vec)
    rows = usable.count()
    if n_clusters > rows:
        raise ValueError(f"{n_clusters} clusters asked for {rows} rows")
    partitions = partitions or max(FIT_PARTITIONS, -(-rows // FIT_ROWS))
    reducer = fit_reducer(usable, vec, n_components, method, key, **graph_options)
    # Shuffle the short reduced vectors, not the originals.
    ready = (
        reducer.transform(as_ml_vector(usable, vec)).select(key, "_reduced")
        .repartition(partitions, key).sortWithinPartitions(key)
        .persist()
    )
    try:
        kmeans = KMeans(
            k=n_clusters, maxIter=max_iter, seed=seed, initSteps=INIT_STEPS,
            featuresCol="_reduced", predictionCol="cluster",
        ).fit(ready)
    finally:
        ready.unpersist()
    return ClusterModel(
        reducer,
        kmeans,
        {"n_components": n_components} | ({"method": method, **graph_options} if method != "pca" else {}),
        {"n_clusters": n_clusters, "max_iter": max_iter, "random_state": seed, "partitions": partitions},
    )


def predict_clusters(df: DataFrame, model: ClusterModel, vec: str = "v") -> DataFrame:
    """Add ``cluster``.  With PCA it stays inside the JVM and needs no shuffle; with the graph reducer
    rows meet the fitted points in joins."""
    reduced = model.reducer.transform(as_ml_vector(df, vec))
    return model.kmeans.transform(reduced).drop("_vector", "_unit", "_reduced")


def get_centroids(model: ClusterModel, spark) -> DataFrame:
    """(cluster, centroid): the k-means centres in the reduced space."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.kmeans.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>")


def nearest_centroid(
    df: DataFrame, centroids: DataFrame, vec: str = "v", key: str = "vec_id", max_centroids: int = MAX_CENTROIDS
) -> DataFrame:
    """Add ``cluster``: the centroid at the least squared distance, ties to the lowest id; null
    for a vector that is null or not finite.

    Up to ``max_centroids`` centroids are sent to every task and the rows are not shuffled;
    beyond that the rows are matched with an exact blocked neighbour join.
    """
    rows = bounded_rows(centroids.select("cluster", "centroid"), max_centroids)
    if rows is None:
        base = centroids.select(F.col("cluster").alias(key), F.col("centroid").alias(vec))
        near = knn_join(df, base, k=1, by=None, key=key, vec=vec, carry=())
        return df.join(near.select(F.col("query_id").alias(key), F.col("neighbor_id").alias("cluster")), key, "left")
    rows.sort(key=lambda r: r["cluster"])
    ids = np.array([r["cluster"] for r in rows])
    centers = np.array([r["centroid"] for r in rows], dtype=np.float64)
    center_norm = np.einsum("ij,ij->i", centers, centers)

    @F.arrow_udf(IntegerType())
    def closest(vectors: pa.Array) -> pa.Array:
        known = np.flatnonzero(np.asarray(vectors.is_valid()))
        out = np.zeros(len(vectors), dtype=np.int32)
        matrix = to_matrix(vectors.drop_null())
        step = max(1, TILE_CELLS // len(centers))
        for start in range(0, len(matrix), step):
            tile = matrix[start:start + step]
            norm = np.einsum("ij,ij->i", tile, tile)
            rough = norm[:, None] + center_norm[None, :] - 2.0 * (tile @ centers.T)
            slack = 1e-9 * (norm + center_norm.max()) + 1e-300
            at, near = np.nonzero(rough <= (rough.min(axis=1) + slack)[:, None])
            gap = tile[at] - centers[near]
            dist = np.einsum("ij,ij->i", gap, gap)
            order = np.lexsort((near, dist, at))
            first = order[np.r_[True, at[order][1:] != at[order][:-1]]] if len(order) else order
            out[known[start:start + step]] = ids[near[first]]
        return pa.array(out, mask=~np.asarray(vectors.is_valid()))

    # Otherwise Catalyst may copy the call into filters and evaluate it again there.
    closest = closest.asNondeterministic()
    return df.withColumn("cluster", closest(F.when(finite(F.col(vec)), F.col(vec))))

