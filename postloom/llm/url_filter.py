"""URL rules and blocklists behind a blocked Bloom filter, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block of the filter is two 64-bit words; each key sets PROBES bits of one block.
BLOCK_BITS = 128
PROBES = 6
#: The filter never has more blocks (16 MB of bits), so it can always be broadcast; a larger list
#: only makes it pass more urls to the exact join.
MAX_BLOCKS = 1 << 20
KEYS_PER_BLOCK = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def blocked_bloom(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter as a table (block, low, high) of at most MAX_BLOCKS rows, and its block count."""
    n = keys.count()
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n and blocks < MAX_BLOCKS:
        blocks *= 2
    at = probe_columns(F.col(key), blocks)
    return keys.select(*at).groupBy("block").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high")), blocks


def probe_columns(key: Column, blocks: int) -> list[Column]:
    """The block a key belongs to and the bits it sets there."""
    place, bits = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    low, high = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(bits, 7 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)
        low = low.bitwiseOR(F.when(bit < 64, mask).otherwise(F.lit(0).cast("long")))
        high = high.bitwiseOR(F.when(bit >= 64, mask).otherwise(F.lit(0).cast("long")))
    return [F.pmod(place, F.lit(blocks)).cast("int").alias("block"), low.alias("low"), high.alias("high")]


def filter_urls(df: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Judge every url by prefix rules and by a list of exact urls.

    ``rules`` has (host string, path string, verdict string): a rule fits its host and all
    subdomains where the url's path starts with the rule's; the longest (host + path) wins.
    ``listed`` has (listed string): urls that are blocked; they are compared in canonical form,
    host + path without a final slash.  Without a fitting rule the verdict is ``block`` for a
    listed url and ``allow`` for any other.

    Every url is turned into the few keys under which a list could hold it: one per (parent
    domain, path prefix of a length that some rule has), and its canonical form.  A blocked Bloom
    filter over all listed keys, a table of bounded size that is broadcast, lets few keys pass; an
    exact join on the key then removes false positives.

    Added columns (input columns of these names are replaced): host, path, rule (host + path of
    the rule, else null), verdict, listed.  A null url or one without ``://`` has an empty host
    and path, no rule and verdict ``allow``.  Repeated rows are judged each on their own;
    repeated or null entries of the lists count once or not at all; empty tables are fine.
    """
    added = ("host", "path", "rule", "verdict", "listed")
    kept = [c for c in df.columns if c not in added]
    # One row per key of the lists; two rules of one key: block wins.
    rule_keys = (
        rules.where("host is not null and path is not null and verdict is not null").select(
            F.concat(F.lit("r"), F.lower("host"), F.lit(" "), "path").alias("k"),
            F.struct((F.char_length("host") + F.char_length("path")).alias("length"),
                     F.concat(F.lower("host"), "path").alias("rule"), F.col("verdict")).alias("hit"),
        ).groupBy("k").agg(F.max_by("hit", F.struct(F.col("hit")["verdict"])).alias("hit"))
    )
    listed_keys = (
        listed.where("listed is not null").select(_canonical(F.col("listed")).alias("k")).distinct()
        .withColumn("hit", F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))
    )
    keys = rule_keys.unionByName(listed_keys)
    bloom, blocks = blocked_bloom(keys, "k")
    lengths = [r[0] for r in rules.where("path is not null").select(F.char_length("path")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"rules have paths of more than {MAX_LENGTHS} different lengths")

    work = df.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # What is asked of the lists depends on (host, path) only: equal urls are asked once.
    asked = work.select("host", "path").distinct().withColumn("_k", F.explode(_asked(F.col("host"), F.col("path"), sorted(lengths))))
    at = probe_columns(F.col("_k"), blocks)
    probed = asked.select("host", "path", "_k", *[c.alias(f"_{n}") for c, n in zip(at, ("block", "low", "high"), strict=True)])
    possible = probed.join(F.broadcast(bloom), F.col("_block") == F.col("block")).where(
        (F.col("_low").bitwiseAND(F.col("low")) == F.col("_low")) & (F.col("_high").bitwiseAND(F.col("high")) == F.col("_high"))
    ).select("host", "path", "_k")
    hits = possible.join(keys, F.col("_k") == F.col("k")).groupBy("host", "path").agg(
        F.max_by("hit", F.struct(F.col("hit")["length"], F.col("hit")["rule"])).alias("_best"),
        F.max(F.col("hit").isNull()).alias("_listed"),
    )
    out = work.join(hits, ["host", "path"], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_best")["rule"].alias("rule"),
        F.coalesce(F.col("_best")["verdict"], F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("_listed", F.lit(False)).alias("listed"),
    )


#: Rules may have paths of so many different lengths.
MAX_LENGTHS = 1000


def _canonical(url: Column) -> Column:
    """Key of an exact url: ``u``, host, path without final slashes."""
    return F.concat(F.lit("u"), host_of(url), F.lit(" "), F.regexp_replace(path_of(url), "/+$", ""))


def _asked(host: Column, path: Column, lengths: list[int]) -> Column:
    exact = F.array(F.concat(F.lit("u"), host, F.lit(" "), F.regexp_replace(path, "/+$", "")))
    prefixes = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    ruled = F.flatten(F.transform(suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(F.lit("r"), h, F.lit(" "), p))))
    return F.when(host != "", F.concat(exact, ruled)).otherwise(F.array().cast("array<string>"))
