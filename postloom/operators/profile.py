"""Descriptive statistics of a table."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators.quantiles import quantiles

def profile_nulls(df: DataFrame) -> DataFrame:
    """One row per column: name, type, null count and row count, from one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    items = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"_{i}").alias("nulls"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counted.select("_rows", F.explode(F.array(*items)).alias("item")).select(
        "item.column", "item.dtype", "item.nulls", F.col("_rows").alias("rows")
    )


def n_unique(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(column).alias("n_unique"))


def count_values(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, unordered: for further aggregation."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return count_values(df, column).orderBy(F.desc("count"), column)


def frequency_shape(df: DataFrame, column: str) -> DataFrame:
    """Sample-adjusted skewness and excess kurtosis of the value counts.

    Null below 3 and 4 values.
    """
    moments = count_values(df, column).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.skewness("count").alias("g1"),
        F.kurtosis("count").alias("g2"),
    )
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    skew = g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    kurt = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)
    return moments.select(
        F.when(n >= 3, skew).alias("skewness"), F.when(n >= 4, kurt).alias("kurtosis")
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles (interpolated) and max per column.

    Quartiles are exact; they are found by counters in a few passes (see ``quantiles``), so that no
    task holds the values of a column.  The passes run when this is called.
    """
    names = ["count", "mean", "std", "min", "max"]
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [
            F.count(c).cast("double").alias(f"{i}_count"),
            F.avg(c).alias(f"{i}_mean"),
            F.stddev(c).alias(f"{i}_std"),
            F.min(c).cast("double").alias(f"{i}_min"),
            F.max(c).cast("double").alias(f"{i}_max"),
        ]
    row = df.agg(*aggregates)
    found = quantiles(df, columns, [0.25, 0.5, 0.75])

    def cells(i, c):
        cell = {n: F.col(f"{i}_{n}") for n in names}
        quartiles = {n: F.lit(q).cast("double") for n, q in zip(("q25", "q50", "q75"), found[c])}
        return [x.alias(n) for n, x in {**{n: cell[n] for n in names[:4]}, **quartiles, "max": cell["max"]}.items()]

    items = [F.struct(F.lit(c).alias("column"), *cells(i, c)) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*items)).alias("item")).select("item.*")


def count_tokens(
    df: DataFrame,
    column: str = "tokens",
    tokens: Callable[[Column], Column] | None = None,
    min_freq: int = 2,
) -> DataFrame:
    """Frequency of every token over all rows, unordered, ``freq >= min_freq``.

    ``tokens`` turns the column into an array; without it the column is one already.
    Hot tokens are combined on the map side.
    """
    array = F.col(column) if tokens is None else tokens(F.col(column))
    return (
        df.select(F.explode(array).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"))
        .where(F.col("freq") >= min_freq)
    )


def by_frequency(counts: DataFrame) -> DataFrame:
    """Most frequent tokens first."""
    return counts.orderBy(F.desc("freq"), "token")
