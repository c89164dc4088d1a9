"""The graph-smoothed reducer as a Spark ML stage: fitted, stored and applied to new points."""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.vectors import finite
from postloom.operators.lineage import stored
from postloom.operators.reduce import N_NEIGHBORS, fuzzy_graph, graph_embed, graph_transform, knn_graph


class _GraphParams(HasInputCol, HasOutputCol):
    keyCol = Param(Params._dummy(), "keyCol", "unique key of the rows fitted on", TypeConverters.toString)
    nComponents = Param(Params._dummy(), "nComponents", "number of coordinates", TypeConverters.toInt)
    nNeighbors = Param(Params._dummy(), "nNeighbors", "neighbours of every point", TypeConverters.toInt)
    graph = Param(Params._dummy(), "graph", "exact or descent", TypeConverters.toString)
    iterations = Param(Params._dummy(), "iterations", "rounds of averaging", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "part of the way to the neighbours' mean", TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(nComponents=50, nNeighbors=N_NEIGHBORS, graph="exact", iterations=5, step=0.5)


def _digest(v: Column) -> Column:
    """128 bits of a vector's components, the same for equal vectors (a negative zero counts as zero)."""
    return F.md5(F.concat_ws(",", F.transform(v, lambda x: (x + F.lit(0.0)).cast("string"))))


class GraphReducer(Estimator, _GraphParams, DefaultParamsReadable, DefaultParamsWritable):
    """PCA coordinates averaged over the fuzzy neighbour graph (see ``reduce``).

    ``inputCol`` holds vectors, ``keyCol`` a unique key.  Rows whose vector is null or not finite are not
    fitted on.  ``graph`` "descent" bounds the distances per row; both graphs are built by joins.
    """

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, keyCol=None, nComponents=50, nNeighbors=N_NEIGHBORS, graph="exact", iterations=5, step=0.5):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "GraphReducerModel":
        rows = dataset.select(F.col(self.getOrDefault("keyCol")).alias("_id"), vector_to_array(self.getInputCol()).alias("_point"))
        rows = stored(rows.where(finite(F.col("_point"))))
        width = rows.select(F.size("_point")).first()
        if width is None:
            raise ValueError("no rows to fit")
        ready = rows.withColumn("_vector", array_to_vector("_point"))
        pca = PCA(k=min(self.getOrDefault("nComponents"), width[0]), inputCol="_vector", outputCol="_coords").fit(ready)
        coords = pca.transform(ready).select("_id", vector_to_array("_coords").alias("_reduced"))
        edges = fuzzy_graph(knn_graph(rows, self.getOrDefault("nNeighbors"), "_id", "_point", method=self.getOrDefault("graph")))
        moved = graph_embed(coords, edges, self.getOrDefault("iterations"), self.getOrDefault("step"), "_id", "_reduced")
        return self._copyValues(GraphReducerModel(stored(rows.join(moved, "_id"))))


class GraphReducerModel(Model, _GraphParams, MLReadable, MLWritable):
    """``base`` has the fitted points: _id, _point (vector) and _reduced (coordinates).

    A row whose vector was fitted on gets the stored coordinates, those of the least key among copies.  Any other
    is placed at the weighted mean of its nearest fitted points, found by the pruned neighbour join; copies are placed once.
    A vector that is null or not finite gets coordinates that are not numbers.  No key is needed, and rows may repeat.
    """

    def __init__(self, base: DataFrame | None = None):
        super().__init__()
        self._defaults()
        self.base = base

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        v = vector_to_array(self.getInputCol())
        rows = dataset.withColumn("_digest", F.when(finite(v), _digest(v)))
        known = self.base.groupBy(_digest(F.col("_point")).alias("_digest")).agg(F.min_by("_reduced", "_id").alias(out))
        points = dataset.select(v.alias("_point")).where(finite(F.col("_point")))
        new = points.groupBy(_digest(F.col("_point")).alias("_id")).agg(F.first("_point").alias("_point"))
        new = stored(new.join(known.select(F.col("_digest").alias("_id")), "_id", "left_anti"))
        if not new.isEmpty():
            placed = graph_transform(new, self.base, self.getOrDefault("nNeighbors"), "_id", "_point", "_reduced")
            known = known.unionByName(placed.select(F.col("_id").alias("_digest"), F.col("_reduced").alias(out)))
        nowhere = F.array_repeat(F.lit(float("nan")), self.base.select(F.size("_reduced")).first()[0])
        return rows.join(known, "_digest", "left").drop("_digest").withColumn(out, array_to_vector(F.coalesce(F.col(out), nowhere)))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    """Parameters as metadata and the fitted points as a table.  A loaded model is stored to another folder only."""

    def __init__(self, model: GraphReducerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.base.write.parquet(f"{path}/base")


class _ModelReader(MLReader):
    def load(self, path: str) -> GraphReducerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = GraphReducerModel(self.sparkSession.read.parquet(f"{path}/base"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
