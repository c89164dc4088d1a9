"""Batch operators over a stream, once per row whatever fails in between.

The neighbour join counts groups and ranks rows, which a streaming plan cannot do; inside of a micro-batch it
can, against a static base.  Each batch is written to a folder of its own number, over what an attempt
that failed may have left there.  Spark gives a batch the same number and the same files when it is
repeated after a restart, so nothing is lost and nothing is there twice.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postloom.operators.cluster import ClusterModel, predict_clusters
from postloom.operators.knn import knn_join
from postloom.operators.lineage import cut_lineage
from postloom.plans.classify import classify_clustered


def write_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes all that has arrived, writes ``transform`` of every batch under ``out`` and ends.

    ``out`` and ``checkpoint`` are folders that all executors share; use the same two after a restart.
    ``transform`` must give the same rows for the same batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All rows written so far, with the number of their batch."""
    return spark.read.parquet(out)


def predict_stream(stream: DataFrame, model: ClusterModel, out: str, checkpoint: str, vec: str = "v") -> StreamingQuery:
    """Add ``cluster`` to every arriving row."""
    return write_batches(stream, lambda batch: predict_clusters(batch, model, vec), out, checkpoint)


def knn_stream(stream: DataFrame, base: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """The neighbours of every arriving row in ``base``; options as for ``knn_join``."""
    stored = cut_lineage(base)
    return write_batches(stream, lambda batch: knn_join(batch, stored, **options), out, checkpoint)


def classify_stream(
    stream: DataFrame, train: DataFrame, out: str, checkpoint: str, model: ClusterModel | None = None, vec: str = "v", **options
) -> StreamingQuery:
    """Classify arriving rows by the neighbours in their cluster of ``train``, as ``classify_clustered`` does.

    With ``model`` both sides get their cluster from it; otherwise they have a column ``cluster``.
    """
    place = (lambda df: predict_clusters(df, model, vec)) if model else (lambda df: df)
    base = cut_lineage(place(train))
    return write_batches(stream, lambda batch: classify_clustered(base, cut_lineage(place(batch)), vec=vec, **options), out, checkpoint)
