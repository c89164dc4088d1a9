"""Vector functions on array columns, computed in double precision inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT_OFFSET = 1e-5


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    def square(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap
    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda total, x: total + x)


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are numbers: neither null, NaN nor infinite."""
    number = F.forall(v, lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(number, F.lit(False))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(sq_l2(a, b))


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # One-element array: binds the norm once per row instead of once per component.
    bound = F.transform(
        F.array(norm),
        lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))),
    )
    return F.get(bound, F.lit(0))


def inverse_distance_weight(sq_dist: Column) -> Column:
    """Vote weight of a neighbour."""
    return F.lit(1.0) / (sq_dist + F.lit(WEIGHT_OFFSET))
