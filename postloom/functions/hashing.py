"""Reproducible pseudo-randomness.

``rand(seed)`` depends on how rows are partitioned.  Everything random in this package
is a function of ``(seed, key)`` instead, so splits, samples and episodes stay the same
under any partitioning and after a lost executor.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(key: Column, *salt) -> Column:
    """Hex MD5 of ``salt:...:key``; ordering by it is a fixed shuffle of the keys."""
    parts = [s if isinstance(s, Column) else F.lit(str(s)) for s in salt]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], key.cast("string")))


def uniform(key: Column, *salt) -> Column:
    """A double in [0, 1) that depends on the salt and the key only."""
    head = F.conv(F.substring(hash_text(key, *salt), 1, 8), 16, 10)
    return head.cast("double") / F.lit(float(2**32))
