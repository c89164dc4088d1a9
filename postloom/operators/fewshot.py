"""Majority categories, class weights and few-shot episodes per cluster."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.hashing import hash_text
from postloom.operators.bounded import broadcast_if_small, local_if_small
from postloom.operators.evaluate import group_sizes, share_of_group
from postloom.operators.lineage import cut_lineage

MAJOR_SHARE = 0.05


def label_counts(df: DataFrame) -> DataFrame:
    """(cluster, category, subcategory, counts): all that the reports below need to know.

    The rows are read once and combined on the map side.  The table is used several times, so
    it becomes a local one, or beyond the bound a stored one.
    """
    counts, small = local_if_small(group_sizes(df, "cluster", "category", "subcategory"))
    return counts if small else cut_lineage(counts)


def _sizes(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("counts").alias("counts"))


def _major(counts: DataFrame, threshold: float) -> DataFrame:
    shares = share_of_group(_sizes(counts, "cluster", "category"), ["cluster"])
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("counts"), "category"))
    # The most frequent category is major in any case: it reaches every share another reaches.
    return shares.withColumn("_place", place).where(
        (F.col("share") >= threshold) | (F.col("_place") == 1)
    ).drop("_place")


def _linked(counts: DataFrame, minimum: int, threshold: float) -> DataFrame:
    supported = _sizes(counts, "cluster", "subcategory").where(F.col("counts") >= minimum)
    return (
        counts.join(_major(counts, threshold).select("cluster", "category"), ["cluster", "category"], "left_semi")
        .join(supported, ["cluster", "subcategory"], "left_semi")
        .select("cluster", "category", "subcategory")
    )


def _weights(counts: DataFrame) -> DataFrame:
    inverse = 1.0 / F.col("counts")
    total = F.sum(inverse).over(Window.partitionBy("cluster"))
    return _sizes(counts, "cluster", "subcategory").withColumn("weight", inverse / total)


def major_categories(df: DataFrame, threshold: float = MAJOR_SHARE) -> DataFrame:
    """(cluster, category, counts, share): categories with at least that share of a cluster;
    where there is none, the most frequent one (ties to the lowest label)."""
    return _major(group_sizes(df, "cluster", "category"), threshold)


def supported_subcategories(df: DataFrame, minimum: int) -> DataFrame:
    """(cluster, subcategory, counts) with at least ``minimum`` rows in the cluster."""
    return group_sizes(df, "cluster", "subcategory").where(F.col("counts") >= minimum)


def associated_subcategories(df: DataFrame, minimum: int, threshold: float = MAJOR_SHARE) -> DataFrame:
    """(cluster, category, subcategory): supported labels seen with each major category."""
    return _linked(label_counts(df), minimum, threshold)


def majority_info(df: DataFrame, minimum: int, threshold: float = MAJOR_SHARE) -> DataFrame:
    """(cluster, major_categories, associated_subcategories): the same as arrays and a map."""
    counts = label_counts(df)
    linked = _linked(counts, minimum, threshold).groupBy("cluster", "category").agg(
        F.sort_array(F.collect_list("subcategory")).alias("subcategories")
    )
    empty = F.array().cast(linked.schema["subcategories"].dataType)
    return (
        _major(counts, threshold).join(linked, ["cluster", "category"], "left")
        .groupBy("cluster")
        .agg(
            F.sort_array(F.collect_list("category")).alias("major_categories"),
            F.map_from_entries(
                F.collect_list(F.struct("category", F.coalesce("subcategories", empty)))
            ).alias("associated_subcategories"),
        )
    )


def class_weights(df: DataFrame) -> DataFrame:
    """(cluster, subcategory, counts, weight): inverse frequency, summing to 1 per cluster."""
    return _weights(group_sizes(df, "cluster", "subcategory"))


def cluster_ranges(df: DataFrame) -> DataFrame:
    """(cluster, start, end): offsets of each cluster in the order sorted by cluster.

    The running sum sees one row per cluster.
    """
    running = F.sum("counts").over(Window.orderBy("cluster"))
    return (
        group_sizes(df, "cluster").withColumn("end", running)
        .select("cluster", (F.col("end") - F.col("counts")).alias("start"), "end")
    )


def few_shot_episodes(
    df: DataFrame,
    n_way: int = 2,
    n_support: int = 2,
    n_query: int = 2,
    seed: int = 42,
    threshold: float = MAJOR_SHARE,
    key: str = "vec_id",
) -> DataFrame:
    """(cluster, role, phase, subcategory, pos, key, weight): one episode per cluster.

    Phase 1 picks up to ``n_way`` labels (no more than there are major categories) among the
    supported labels of the major categories and draws ``n_support`` support and ``n_query``
    query rows of each.  Phase 2 picks up to ``n_way`` of the other supported labels and
    draws ``n_query`` query rows of each.  Draws follow the hash of (seed, cluster, key).

    Labels are picked on one table of counts; the rows are then read once, filtered to the
    picked labels, and each partition keeps its first few rows per label before the shuffle.
    """
    draw = n_support + n_query
    counts = label_counts(df)
    majors = _major(counts, threshold).groupBy("cluster").agg(F.count(F.lit(1)).alias("_majors"))
    linked = _linked(counts, draw, threshold).select("cluster", "subcategory").distinct()
    candidates = (
        _weights(counts).where(F.col("counts") >= draw)
        .join(majors, "cluster")
        .join(linked.withColumn("_major", F.lit(True)), ["cluster", "subcategory"], "left")
        .withColumn("_major", F.coalesce("_major", F.lit(False)))
    )

    def place(phase, *first):
        order = hash_text(F.col("subcategory"), seed, F.col("cluster"), phase)
        return F.row_number().over(Window.partitionBy("cluster").orderBy(*first, order, "subcategory"))

    picked = (
        candidates
        .withColumn("_place", place("major", F.desc("_major")))
        .withColumn("_first", F.col("_major") & (F.col("_place") <= F.least(F.lit(n_way), F.col("_majors"))))
        .withColumn("_rest", place("rest", F.asc("_first")))
        .where(F.col("_first") | (F.col("_rest") <= n_way))
        .select("cluster", "subcategory", "weight", F.when(F.col("_first"), 1).otherwise(2).alias("phase"))
    )
    order = Window.partitionBy("cluster", "subcategory").orderBy(
        hash_text(F.col(key), seed, F.col("cluster")), key
    )
    drawn = (
        df.select("cluster", "subcategory", key)
        .join(broadcast_if_small(picked), ["cluster", "subcategory"])
        .withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= draw)  # a constant: lets Spark keep only these before the shuffle
        .where((F.col("phase") == 1) | (F.col("pos") <= n_query))
    )
    support = (F.col("phase") == 1) & (F.col("pos") <= n_support)
    return drawn.select(
        "cluster", F.when(support, "support").otherwise("query").alias("role"), "phase", "subcategory",
        "pos", key, "weight",
    )
