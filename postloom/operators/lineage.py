"""Cutting lineage in iterative jobs, in storage that outlives an executor."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made in local mode only, where driver and tasks share a disk.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="postloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a folder of its own in the same place and read back.

    A checkpoint computes its rows a second time in order to write them; this does not.
    """
    return _written(df)[1]


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="postloom-stored-")
    path = f"{folder}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of an iterative job, written to a folder of their own in the same place.

    ``keep`` writes one and reads it back; what was shuffled for it is deleted when it is written.  ``keep_only`` deletes
    the tables that later steps do not read.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            path, table = _written(df)
        finally:
            self.spark.conf.unset(self.CLEANUP) if before is None else self.spark.conf.set(self.CLEANUP, before)
        self.kept.append((table, path))
        return table

    def keep_only(self, *tables: DataFrame) -> None:
        for table, folder in self.kept:
            if not any(table is x for x in tables):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.kept = [x for x in self.kept if any(x[0] is y for y in tables)]
