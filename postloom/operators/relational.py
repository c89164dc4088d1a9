"""Projections, filters and the label lookup."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.bounded import broadcast_if_small

# Source column -> our name, in output order; None drops the column.
POST_COLUMNS = {
    "id": "id",
    "subreddit": "subreddit",
    "title": "title",
    "selftext": "text",
    "category_1": "category",
    "category_2": "subcategory",
    "category_3": None,
    "in_data": None,
    "reason_for_exclusion": None,
}
NOISE_CLUSTER = -1


def select_mapped(df: DataFrame, mapping: Mapping[str, str | None] = POST_COLUMNS) -> DataFrame:
    """Keep and rename the columns that have a name in the map, in the map's order."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items() if new is not None])


def enrich(posts: DataFrame, lookup: DataFrame, on: str = "subreddit") -> DataFrame:
    """Left join of the label lookup.

    A lookup within the bound of ``broadcast_if_small`` goes to the posts, which then stay where they
    are: their keys are few, and a shuffle would put them into as many tasks.  A larger one is joined by shuffle
    with AQE splitting hot keys.
    """
    return posts.join(lookup if lookup.isStreaming else broadcast_if_small(lookup), on, "left")


def attach(df: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """Add computed columns to the rows they were computed from, matched by key."""
    return df.join(values, on, "left")


def drop_noise(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.where(F.col(cluster) != NOISE_CLUSTER)


def with_support(df: DataFrame, by: list[str], minimum: int) -> DataFrame:
    """Groups that have at least ``minimum`` rows, with their size ``n``."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)


def union_splits(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, matched by column name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def top_n(df: DataFrame, by: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` rows with the highest value; ties go to the lower key."""
    return df.orderBy(F.desc(by), F.asc(key)).limit(n)


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def matches(set_column: Column, value: Column) -> Column:
    """Membership with ``false`` for a missing set."""
    return F.coalesce(F.array_contains(set_column, value), F.lit(False))
