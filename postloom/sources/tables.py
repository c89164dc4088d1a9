"""Readers and writers for posts, labels, splits, vectors, prototypes and models."""

import json

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postloom.operators.cluster import ClusterModel

POSTS = ("id", "subreddit", "title", "selftext")
LOOKUP = ("subreddit", "category_1", "category_2", "category_3", "in_data", "reason_for_exclusion")
SPLITS = ("train", "validation", "test")


def _strings(names) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _delimited(spark: SparkSession, path: str, columns, sep: str, multiline: bool) -> DataFrame:
    # A record of the wrong width, such as half of a broken one, fails the job.
    return (
        spark.read.schema(_strings(columns)).option("mode", "FAILFAST")
        .option("sep", sep).option("header", True).option("enforceSchema", False)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .csv(path)
    )


def read_posts(spark: SparkSession, path: str, columns=POSTS, multiline: bool = True) -> DataFrame:
    """Tab-separated posts with a header; all columns are strings.

    Texts may hold line breaks inside quotes.  Such files cannot be split between tasks, so
    prefer many files; ``multiline=False`` splits files whose records are single lines.  A
    malformed record fails the job in either mode.
    """
    return _delimited(spark, path, columns, "\t", multiline)


def read_posts_checked(spark: SparkSession, path: str, columns=POSTS, multiline: bool = True) -> tuple[DataFrame, DataFrame, Observation]:
    """(posts, rejects, counts): the well-formed records, the others, and how many of each were read.

    ``rejects`` has the file, the record's text and its fields as far as they could be told apart.  ``counts``
    is filled when ``posts`` has been computed: ``counts.get`` gives ``posts`` and ``rejects``.  With
    ``multiline`` a quote that is never closed makes one record of the rest of its file.
    """
    counts = Observation()
    rows = (
        spark.read.schema(_strings([*columns, "_text"])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_text")
        .option("sep", "\t").option("header", True).option("enforceSchema", True)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .csv(path)
    )
    broken = F.col("_text").isNotNull()
    # Fields are part of every read: Spark does not tell whether a record is broken without parsing it.
    fields = F.array(*[F.col(c) for c in columns])
    rejects = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_text").alias("record"), fields.alias("fields")).where("record is not null")
    posts = rows.observe(counts, F.count_if(~broken).alias("posts"), F.count_if(broken).alias("rejects")).where(~broken).select(*columns)
    return posts, rejects, counts


def read_lookup(spark: SparkSession, path: str, columns=LOOKUP) -> DataFrame:
    """Comma-separated labels per source with a header."""
    return _delimited(spark, path, columns, ",", True)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that has fewer partitions than there are cores.

    For work that costs far more than moving the rows, such as cleaning text.  A large
    input has more partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_splits(df: DataFrame, path: str, num_files: int | None = None) -> None:
    """One folder per split.

    Rows are not shuffled by split, which would leave three tasks with all the data.  With
    ``num_files`` they are spread evenly over that many tasks, each of which writes at most
    one file per split.
    """
    if num_files is not None:
        df = df.repartition(num_files)
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, splits=None) -> DataFrame:
    """All splits, or only the named ones: other folders are not read."""
    df = spark.read.parquet(path)
    return df if splits is None else df.where(F.col("split").isin(list(splits)))


def read_embeddings(spark: SparkSession, path: str, vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """Vectors; with ``dim`` the job fails on a vector of another length."""
    df = spark.read.parquet(path)
    if dim is None:
        return df
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} components, found "), F.size(vec).cast("string")))
    kind = df.schema[vec].dataType
    return df.withColumn(vec, F.when(F.size(vec) == dim, F.col(vec)).otherwise(wrong.cast(kind)))


def write_vectors(df: DataFrame, path: str) -> None:
    """Keyed vectors with their cluster and label, as one table."""
    df.write.mode("overwrite").parquet(path)


def vectors_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at ``path`` if there is one; else ``compute()`` is stored there and read back."""
    if not exists(spark, path + "/_SUCCESS"):
        write_vectors(compute(), path)
    return spark.read.parquet(path)


def write_prototypes(prototypes: DataFrame, path: str) -> None:
    """Prototypes in one folder per cluster, so a search reads its own cluster only.

    Spread by cluster and label: a cluster with many labels is written by many tasks.
    """
    spread = prototypes.repartition("cluster", F.pmod(F.xxhash64("subcategory"), F.lit(16)))
    spread.write.mode("overwrite").partitionBy("cluster").parquet(path)


def write_centroids(centroids: DataFrame, path: str) -> None:
    centroids.write.mode("overwrite").parquet(path)


def build_prototype_index(prototypes: DataFrame, centroids: DataFrame, path: str) -> None:
    """Searchable tables: prototypes by cluster and all centroids with their cluster id."""
    write_prototypes(prototypes, f"{path}/prototypes")
    write_centroids(centroids, f"{path}/centroids")


def read_prototype_index(spark: SparkSession, path: str, cluster: int | None = None):
    """(prototypes, centroids); with ``cluster`` only that cluster's folder is read."""
    prototypes = spark.read.parquet(f"{path}/prototypes")
    if cluster is not None:
        prototypes = prototypes.where(F.col("cluster") == cluster)
    return prototypes, spark.read.parquet(f"{path}/centroids")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _save_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _load_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_reducer(spark: SparkSession, model: ClusterModel, path: str) -> None:
    model.reducer.write().overwrite().save(f"{path}/reducer")
    _save_config(spark, model.reducer_config, f"{path}/reducer_config")


def save_kmeans(spark: SparkSession, model: ClusterModel, path: str) -> None:
    model.kmeans.write().overwrite().save(f"{path}/kmeans")
    _save_config(spark, model.cluster_config, f"{path}/kmeans_config")


def save_model(spark: SparkSession, model: ClusterModel, path: str) -> None:
    """Both parts, each with the settings it was fitted with."""
    save_reducer(spark, model, path)
    save_kmeans(spark, model, path)


def _required(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"no model at {path}")
    return path


def load_reducer(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(_required(spark, f"{path}/reducer"))


def load_kmeans(spark: SparkSession, path: str) -> KMeansModel:
    return KMeansModel.load(_required(spark, f"{path}/kmeans"))


def load_model(spark: SparkSession, path: str) -> ClusterModel:
    return ClusterModel(
        load_reducer(spark, path),
        load_kmeans(spark, path),
        _load_config(spark, f"{path}/reducer_config"),
        _load_config(spark, f"{path}/kmeans_config"),
    )
