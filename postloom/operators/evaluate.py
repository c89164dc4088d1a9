"""Prediction metrics and cluster quality reports."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.bounded import local_if_small


def confusion(predictions: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_scores(predictions: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Per label in truth or prediction: hits, support, predicted, precision, recall, f1.

    One pass over the rows; everything after the confusion counts is label-sized.  A row
    without prediction counts as wrong.
    """
    n, hit = F.col("n"), F.col("truth").eqNullSafe(F.col("prediction"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.when(hit, n).otherwise(zero).alias("hits"),
                 n.alias("support"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("label"), zero.alias("hits"),
                 zero.alias("support"), n.alias("predicted")),
    )
    counts = (
        confusion(predictions, truth, prediction)
        .select(F.explode(sides).alias("side")).select("side.*")
        .where("label is not null")
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "support", "predicted")])
    )
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return (
        counts
        .withColumn("precision", F.coalesce(F.try_divide(hits, predicted), F.lit(0.0)))
        .withColumn("recall", F.coalesce(F.try_divide(hits, support), F.lit(0.0)))
        .withColumn("f1", 2 * hits / (support + predicted))
    )


def evaluate(predictions: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and macro-averaged precision, recall and F1."""
    return label_scores(predictions, truth, prediction).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
    )


def accuracy(predictions: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    hit = F.coalesce(F.col(truth) == F.col(prediction), F.lit(False))
    return predictions.agg(
        F.count_if(hit).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def group_sizes(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("counts"))


def cluster_label_sets(train: DataFrame) -> DataFrame:
    """(cluster, subcategories): the sorted set of labels seen in each cluster.

    Labels are made distinct before they are collected, so a hot cluster costs its labels,
    not its rows.
    """
    return (
        train.select("cluster", "subcategory").distinct()
        .groupBy("cluster")
        .agg(F.sort_array(F.collect_list("subcategory")).alias("subcategories"))
    )


def cluster_recall_density(train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """Test rows with what the training rows say about their cluster.

    ``hit``: the true label occurs in the cluster; ``counts`` / ``cluster_size``: rows of
    that label and of the whole cluster; ``proportion`` is their ratio.  Test rows in a
    cluster without training rows are left out.
    """
    counts, small = local_if_small(group_sizes(train, "cluster", "subcategory"))
    by_cluster = counts.groupBy("cluster").agg(
        F.sort_array(F.collect_list("subcategory")).alias("subcategories"),
        F.sum("counts").alias("cluster_size"),
    )
    if small:  # the sets hold as many labels as ``counts`` has rows
        counts, by_cluster = F.broadcast(counts), F.broadcast(by_cluster)
    rows = test.select(key, "category", "cluster", "subcategory")
    return (
        rows.join(by_cluster, "cluster")
        .join(counts, ["cluster", "subcategory"], "left")
        .withColumn("hit", F.col("counts").isNotNull())
        .withColumn("counts", F.coalesce("counts", F.lit(0).cast("long")))
        .withColumn("proportion", F.col("counts") / F.col("cluster_size"))
        .select(key, "category", "cluster", "subcategory", "subcategories", "hit", "counts",
                "cluster_size", "proportion")
    )


def cluster_quality(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per cluster: recall (share of test rows whose label occurs in the cluster's training
    rows) and density (share of the most common training label)."""
    counts = group_sizes(train, "cluster", "subcategory")
    density = counts.groupBy("cluster").agg((F.max("counts") / F.sum("counts")).alias("density"))
    # Test rows are counted per (cluster, label) first: the join is label-sized.
    seen = (
        group_sizes(test, "cluster", "subcategory").withColumnRenamed("counts", "tests")
        .join(counts, ["cluster", "subcategory"], "left")
        .groupBy("cluster")
        .agg((F.sum(F.when(F.col("counts").isNotNull(), F.col("tests")).otherwise(0))
              / F.sum("tests")).alias("recall"))
    )
    return density.join(seen, "cluster", "full").select("cluster", "recall", "density")


def share_of_group(counts: DataFrame, by: list[str], n: str = "counts") -> DataFrame:
    """Add ``share``: the count divided by the total of its group."""
    total = F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn("share", F.col(n) / total)
