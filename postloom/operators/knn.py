"""Exact k-nearest-neighbour join on squared Euclidean distance.

Queries meet the base rows of their own group.  Groups are cut into blocks (see
``blocks``), small ones in bundles: each query is sent to every bundle of base blocks of its group, each base
row to every bundle of query blocks, and a pair of them yields a partial top-k.  The top-k of the partial top-k is
the exact result.  Ties are broken by the neighbour's key, so the result does not depend
on partitioning or block size.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DoubleType, IntegerType, StructField, StructType

from postloom.functions.vectors import finite
from postloom.operators.blocks import (
    BLOCK_ROWS,
    crowded_groups,
    every_block,
    own_block,
    spread_blocks,
    with_block_count,
)

TILE_CELLS = 4_000_000  # distances held at once
GROUP = 64  # columns per group when bounding the k-th smallest distance
PAIR_FLOATS = 8_000_000  # floats held at once while exact distances are computed
BUNDLE_ROWS = 4096  # rows of small blocks that move together
COARSE = 16  # times k candidates in a row, in the mean, beyond which single precision is too coarse
MAX_LIST = 1000  # neighbours of a query that may be one row
MERGE_PAIRS = 1_000_000  # pairs of several blocks held before they are merged


def to_matrix(column, number=np.float64) -> np.ndarray:
    """An Arrow list column as a matrix of float64 or another type; rows of different widths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    width = pc.min_max(pc.list_value_length(column)).as_py()
    if width["min"] != width["max"]:
        raise ValueError(f"vectors of {width['min']} and of {width['max']} components in one column")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(number).reshape(len(column), -1)


def rejected(df: DataFrame, key: str = "vec_id", vec: str = "v") -> DataFrame:
    """(key): the rows whose vector no neighbour operator can use."""
    return df.where(~finite(F.col(vec))).select(key)


def exact_sq_dist(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sum of squared differences for the listed pairs, in bounded memory."""
    step = max(1, PAIR_FLOATS // max(1, a.shape[1]))
    out = np.empty(len(rows))
    for i in range(0, len(rows), step):
        gap = a[rows[i:i + step]] - b[cols[i:i + step]]
        out[i:i + step] = np.einsum("ij,ij->i", gap, gap)
    return out


def first_copies(matrix: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k lowest-ordered rows of every distinct vector.

    Further copies can never be among the k nearest, because ties go to the lower key.
    """
    _, group = np.unique(matrix, axis=0, return_inverse=True)
    group = group.ravel()
    by_group = np.lexsort((order, group))
    sorted_group = group[by_group]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    sizes = np.diff(np.r_[starts, len(sorted_group)])
    nth = np.arange(len(sorted_group)) - np.repeat(starts, sizes)
    return np.sort(by_group[nth < k])


def kth_bound(rough: np.ndarray, k: int) -> np.ndarray:
    """Per row an upper bound on the k-th smallest value.

    The k-th smallest of the minima of disjoint groups of columns: k groups hold a value
    that small.  Much cheaper than selecting among all columns, and hardly larger.
    """
    groups = rough.shape[1] // GROUP
    if groups < 4 * k:
        return np.partition(rough, k - 1, axis=1)[:, k - 1]
    whole = rough[:, :groups * GROUP].reshape(len(rough), GROUP, groups).min(axis=1)
    minima = np.hstack([whole, rough[:, groups * GROUP:]])
    return np.partition(minima, k - 1, axis=1)[:, k - 1]


def candidates(tile: np.ndarray, extended: np.ndarray, slack, k: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, column) of what may be among the k smallest of a row of the estimates ``tile @ extended``, all of which are
    off by half of ``slack`` at most.  None if ``slack`` is too coarse to tell the near ones from many others.
    ``room`` holds the estimates of one tile: new memory for every tile would cost a third of the time."""
    rough = np.matmul(tile, extended, out=room[:len(tile)])
    limit = (kth_bound(rough, k) + slack).astype(rough.dtype, copy=False)
    near = (rough <= limit[:, None]).ravel()
    if rough.dtype == np.float32 and np.count_nonzero(near) > COARSE * k * len(tile):
        return None
    # Hits are rare: eight places are looked at together.
    whole = len(near) // 8 * 8
    words = np.flatnonzero(near[:whole].view(np.uint64))
    hits = (words[:, None] * 8 + np.arange(8)).ravel()
    hits = np.concatenate([hits[near[hits]], whole + np.flatnonzero(near[whole:])])
    return np.divmod(hits, rough.shape[1])


def nearest_k(queries: np.ndarray, base: np.ndarray, base_order: np.ndarray, k: int):
    """(query position, base position, squared distance, rank) of the k nearest base rows.

    Distances are first estimated with one matrix product (without the query's own norm,
    which does not change the order); every base row that could be among the k nearest,
    allowing for rounding, is then measured exactly.  Estimates are in single precision, about the
    mean and scaled to norms of at most 1, where their error has a fixed bound; if that is too coarse for
    rows that lie very close together, they are in double precision.
    """
    kept = first_copies(base, base_order, k)
    base, base_order = base[kept], base_order[kept]
    k = min(k, len(base))
    centre = base.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        shifted = base - centre
        square = np.einsum("ij,ij->i", shifted, shifted)
        largest = max((np.einsum("ij,ij->i", t, t).max() for t in (queries[i:i + 4096] - centre for i in range(0, len(queries), 4096))), default=0.0)
        largest = max(largest, square.max())
    single = bool(np.isfinite(largest) and largest > 1e-200)
    if single:
        size = np.sqrt(largest)
        shifted /= size
        short = np.ascontiguousarray(np.column_stack([shifted, square / largest]).T, dtype=np.float32)
        # Conversions and d + 1 rounded sums of terms whose sizes sum to 3 at most, for the bound and for the row.
        short_slack = 2.0 * (4 * base.shape[1] + 16) * 2.0**-24
    del shifted
    base_norm = np.einsum("ij,ij->i", base, base)
    step = max(1, TILE_CELLS // len(base))
    room = np.empty((min(step, len(queries)), len(base)), np.float32 if single else np.float64)
    extended = None
    found = []
    start = 0
    while start < len(queries):
        at = None
        tile = queries[start:start + step]
        if single:
            scaled = np.column_stack([(tile - centre) * (-2.0 / size), np.ones(len(tile))]).astype(np.float32)
            at = candidates(scaled, short, np.full(len(tile), short_slack), k, room)
            single = at is not None
        if at is None:
            if extended is None:
                extended = np.ascontiguousarray(np.column_stack([base, base_norm]).T)
                room = room.astype(np.float64, copy=False)
            slack = 1e-9 * (np.einsum("ij,ij->i", tile, tile) + base_norm.max()) + 1e-300
            at = candidates(np.column_stack([-2.0 * tile, np.ones(len(tile))]), extended, slack, k, room)
        rows, cols = at
        dist = exact_sq_dist(tile, base, rows, cols)
        order = np.lexsort((base_order[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        starts = np.searchsorted(rows, np.arange(len(tile)))
        rank = np.arange(len(rows)) - starts[rows] + 1
        best = rank <= k
        found.append((rows[best] + start, kept[cols[best]], dist[best], rank[best]))
        start += len(tile)
    return tuple(np.concatenate(part) for part in zip(*found))


def nearest_in_blocks(queries: np.ndarray, base: np.ndarray, base_order: np.ndarray, block: np.ndarray, k: int):
    """The same with the base rows taken block by block; what is held is bounded by merging."""
    blocks = [rows for rows in np.split(np.argsort(block, kind="stable"), np.cumsum(np.bincount(block))[:-1]) if len(rows)]
    if len(blocks) == 1:
        return nearest_k(queries, base, base_order, k)
    held: list = []

    def merged():
        at, near, dist = (np.concatenate(part) for part in zip(*held))
        order = np.lexsort((base_order[near], dist, at))
        at, near, dist = at[order], near[order], dist[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
        best = rank <= k
        return at[best], near[best], dist[best], rank[best]

    size = 0
    for rows in blocks:
        at, near, dist, _ = nearest_k(queries, base[rows], base_order[rows], k)
        held.append((at, rows[near], dist))
        size += len(at)
        if size > max(MERGE_PAIRS, 4 * k * len(queries)):
            held[:] = [merged()[:3]]
            size = len(held[0][0])
    return merged()


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int = 5,
    by: str | Sequence[str] | None = "cluster",
    key: str = "vec_id",
    vec: str = "v",
    carry: Sequence[str] = ("subcategory",),
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    prune: bool = True,
) -> DataFrame:
    """(by..., query_id, rank, neighbor_id, sq_dist, carry...).

    Fewer than ``k`` rows come back where the group is smaller; a query whose group has no
    base rows has none.  Vectors that are null or not finite are no neighbours and find none
    (``rejected`` lists them); different widths are an error.  With ``prune`` a group that needs several
    blocks is searched through cells of its own where that saves work (see ``pruned``).  ``carry`` are base columns to bring along.  With ``exclude_self``
    a base row with the query's key is not a neighbour.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    carry = list(carry)
    everywhere = not by
    if everywhere:
        by = ["_all"]
        block_rows = spread_blocks(base, block_rows)
        queries, base = queries.withColumn("_all", F.lit(0)), base.withColumn("_all", F.lit(0))
    usable = finite(F.col(vec))
    for c in by:
        usable = usable & F.col(f"`{c}`").isNotNull()
    # Aliases keep both sides apart when they come from the same table.
    groups = [F.col(c).alias(c) for c in by]
    q = queries.where(usable).select(*groups, F.col(key).alias("query_id"), F.col(vec).alias("v"))
    b = base.where(usable).select(*groups, F.col(key).alias("neighbor_id"), F.col(vec).alias("v"), *carry)

    crowd = crowded_groups(block_rows, by, base=b, query=q)
    if prune and not everywhere and crowd["base"] is not None:
        from postloom.operators.pruned import knn_join_in_cells

        found = knn_join_in_cells(q, b, crowd["base"], k, by, carry, exclude_self, block_rows)
        if found is not None:
            return found

    # Small blocks move in bundles, or a row would be copied for every block of the other side.  Blocks of a whole
    # table are as small as its spread over the cores asks for.
    together = 1 if everywhere else max(1, BUNDLE_ROWS // block_rows)

    def placed(df, own_key, own, other):
        df = with_block_count(df, crowd["base"], by, "_base_blocks")
        df = with_block_count(df, crowd["query"], by, "_query_blocks")
        df = df.withColumn("_own", own_block(own_key, f"_{own}_blocks"))
        df = df.withColumn(f"_{own}", F.floor(F.col("_own") / together).cast("int"))
        return df.withColumn("_bundles", F.ceil(F.col(f"_{other}_blocks") / together).cast("int")).withColumn(
            f"_{other}", every_block("_bundles")
        ).drop("_base_blocks", "_query_blocks", "_bundles")

    cell = [*by, "_base", "_query"]
    left = placed(q, "query_id", "query", "base").groupBy(*cell)
    right = placed(b, "neighbor_id", "base", "query").groupBy(*cell)
    fields = [f for f in b.schema.fields if f.name in by]
    fields += [
        StructField("query_id", q.schema["query_id"].dataType),
        StructField("rank", IntegerType()),
        StructField("neighbor_id", b.schema["neighbor_id"].dataType),
        StructField("sq_dist", DoubleType()),
    ]
    fields += [b.schema[c] for c in carry]
    schema = StructType(fields)
    # Over a whole table a query has a partial result per base block: these move as one row each, not k.
    packed = everywhere and crowd["base"] is not None and k <= MAX_LIST and all(isinstance(b.schema[c].dataType, AtomicType) for c in carry)
    link = StructType([StructField(n, schema[n].dataType) for n in ("sq_dist", "neighbor_id", *carry)])

    def partial_top_k(queries: pa.Table, base: pa.Table) -> pa.Table:
        names = [*([] if not packed else ["_at"]), *[f.name for f in schema.fields]]
        if not queries.num_rows or not base.num_rows:
            source = queries if queries.num_rows else base
            types = {"rank": pa.int32(), "sq_dist": pa.float64(), "_at": pa.int64()}
            types.update({c: base.schema.field(c).type for c in ["neighbor_id", *by, *carry]})
            types["query_id"] = queries.schema.field("query_id").type
            return pa.table({n: pa.array([], types[n]) for n in names})
        # Ranks of the keys: tie order for any key type.
        order = pc.rank(base["neighbor_id"], tiebreaker="first").to_numpy()
        width = k + 1 if exclude_self else k
        block = base["_own"].to_numpy()
        at, near, dist, rank = nearest_in_blocks(to_matrix(queries["v"]), to_matrix(base["v"]), order, block, width)
        out = {"query_id": queries["query_id"].take(at), "neighbor_id": base["neighbor_id"].take(near)}
        if exclude_self:
            other = pc.not_equal(out["query_id"], out["neighbor_id"]).combine_chunks().to_numpy(zero_copy_only=False)
            at, near, dist = at[other], near[other], dist[other]
            starts = np.searchsorted(at, at)
            rank = np.arange(len(at)) - starts + 1
            best = rank <= k
            at, near, dist, rank = at[best], near[best], dist[best], rank[best]
            out = {"query_id": queries["query_id"].take(at), "neighbor_id": base["neighbor_id"].take(near)}
        out["_at"] = pa.array(at)
        out["rank"] = pa.array(rank.astype(np.int32))
        out["sq_dist"] = pa.array(dist)
        for c in [*by, *carry]:
            out[c] = base[c].take(near)
        return pa.table({n: out[n] for n in names})

    def partial_lists(queries: pa.Table, base: pa.Table) -> pa.Table:
        found = partial_top_k(queries, base)
        ids, counts, near = queries["query_id"], np.zeros(queries.num_rows, np.int64), [found[n].combine_chunks() for n in link.names]
        if found.num_rows:
            counts = np.bincount(found["_at"].to_numpy(), minlength=len(counts))
        lists = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.StructArray.from_arrays(near, link.names))
        return pa.table({"query_id": ids, "near": lists})

    if packed:
        lists = StructType([StructField("query_id", schema["query_id"].dataType), StructField("near", ArrayType(link))])
        partial = left.cogroup(right).applyInArrow(partial_lists, lists).where(F.size("near") > 0)
        nearest = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
        merged = partial.groupBy("query_id").agg(nearest.alias("near")).select("query_id", F.posexplode("near").alias("rank", "near"))
        return merged.select("query_id", (F.col("rank") + 1).alias("rank"), "near.neighbor_id", "near.sq_dist", *[F.col("near").getField(c).alias(c) for c in carry])
    partial = left.cogroup(right).applyInArrow(partial_top_k, schema)
    if crowd["base"] is not None:
        nearest = Window.partitionBy("query_id").orderBy("sq_dist", "neighbor_id")
        partial = partial.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return partial.drop("_all") if everywhere else partial
