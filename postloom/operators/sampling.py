"""Exact-size samples and splits without sorting the data.

A shuffle with a seed is the order of the keys by their salted hash.  To take the first
``n`` keys of that order, count the keys per hash prefix (65536 counters, combined on the
map side), find the prefix in which position ``n`` falls, and look up the one key there.
The selection itself is then a comparison with two literals: no shuffle of the rows.
Keys are expected to be unique; rows that share a key stay together.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.hashing import hash_text, uniform

DIGITS = 4  # hex digits per level: 65536 counters
FEW_KEYS = 10_000


def _counters(hashed: DataFrame, digits: int, heads=None):
    head = F.substring("hash", 1, digits).alias("head")
    if heads is not None:
        hashed = hashed.where(F.substring("hash", 1, digits - DIGITS).isin(heads))
    counts = hashed.groupBy(head).count().toArrow()
    return sorted(zip(counts["head"].to_pylist(), counts["count"].to_pylist()))


def _cutoffs(df: DataFrame, key: str, seed, sizes):
    """Row count and, for each of ``sizes(row count)``, the last selected (hash, key).

    Positions are narrowed down level by level, all together: each level is one pass over
    the keys that gives the driver at most 65536 counters per position.
    """
    hashed = df.select(F.col(key).alias("key"), hash_text(F.col(key), seed).alias("hash"))
    counters = _counters(hashed, DIGITS)
    total = sum(n for _, n in counters)
    wanted = {i: [size, "", total] for i, size in enumerate(sizes(total)) if 0 < size < total}
    for digits in range(DIGITS, 33, DIGITS):
        for state in wanted.values():
            position, parent, _ = state
            for head, n in counters:
                if not head.startswith(parent):
                    continue
                if position <= n:
                    break
                position -= n
            state[:] = position, head, n
        if all(n <= FEW_KEYS for _, _, n in wanted.values()):
            break
        counters = _counters(hashed, digits + DIGITS, [head for _, head, _ in wanted.values()])
    bounds = {}
    for i, (position, head, _) in wanted.items():
        rest = hashed.where(F.col("hash").startswith(head)).orderBy("hash", "key").limit(position)
        bounds[i] = tuple(rest.agg(F.max(F.struct("hash", "key")).alias("last")).first()["last"])
    return total, [bounds.get(i) for i in range(len(sizes(total)))]


def _up_to(key: str, seed, size: int, total: int, bound) -> Column:
    if size <= 0:
        return F.lit(False)
    if size >= total:
        return F.lit(True)
    digest, last = hash_text(F.col(key), seed), bound
    return (digest < last[0]) | ((digest == last[0]) & (F.col(key) <= F.lit(last[1])))


def sample_n(
    df: DataFrame, key: str, n: int | None = None, ratio: float | None = None, seed: int = 42
) -> DataFrame:
    """The first ``n`` (or ``int(rows * ratio)``) rows of a seeded shuffle."""
    if (n is None) == (ratio is None):
        raise ValueError("give n or ratio")
    size = (lambda total: int(total * ratio)) if n is None else (lambda total: n)
    total, bounds = _cutoffs(df, key, seed, lambda t: [size(t)])
    return df.where(_up_to(key, seed, size(total), total, bounds[0]))


def split_sizes(total: int, test_size: float = 0.2, validation_share: float = 0.5):
    """Rows of train, test and validation; held-out parts are rounded up."""
    held = math.ceil(round(total * test_size, 9))
    validation = math.ceil(round(held * validation_share, 9))
    return total - held, held - validation, validation


def random_split(
    df: DataFrame, key: str, test_size: float = 0.2, validation_share: float = 0.5, seed: int = 42
) -> DataFrame:
    """Add ``split`` in {train, test, validation} with exact sizes."""
    def ends(total):
        train, test, _ = split_sizes(total, test_size, validation_share)
        return [train, train + test]

    total, bounds = _cutoffs(df, key, seed, ends)
    train_end, test_end = ends(total)
    return df.withColumn(
        "split",
        F.when(_up_to(key, seed, train_end, total, bounds[0]), "train")
        .when(_up_to(key, seed, test_end, total, bounds[1]), "test")
        .otherwise("validation"),
    )


def hash_split(
    df: DataFrame, key: str, train: float = 0.8, test: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` by comparing a hash with the shares: one pass, expected sizes.

    A row's split does not depend on the other rows, so it also holds for data that grows.
    """
    u = uniform(F.col(key), seed)
    return df.withColumn(
        "split", F.when(u < train, "train").when(u < train + test, "test").otherwise("validation")
    )
