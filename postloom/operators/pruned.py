"""Exact nearest neighbours over a whole table without meeting all pairs of blocks.

Base rows are assigned to the nearest of a few pivots.  A cell is described by its radius
and by the distance within which it holds k rows.  From its distances to the pivots alone a
query knows an upper bound on its k-th neighbour's distance, and for every cell a lower
bound on the distance to anything inside; cells whose lower bound is larger cannot hold a
neighbour and are left out.  The query is sent to the remaining cells, so the result is the
same as without pruning.

How much is saved depends on the data: a lot for clustered vectors, nothing for vectors
without structure.  That is found out from a few queries, and ``knn_join`` is used then.
"""

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from postloom.functions.hashing import uniform
from postloom.functions.vectors import finite
from postloom.operators.bounded import bounded_rows
from postloom.operators.knn import BLOCK_ROWS, TILE_CELLS, knn_join, to_matrix
from postloom.operators.lineage import cut_lineage
from postloom.operators.sampling import sample_n

# Cells follow the square root of the base rows, so that the distances to pivots and the
# rows of a visited cell grow alike; every task holds all pivots.
MIN_CELLS, MAX_CELLS = 16, 8192
WORTH_SHARE = 0.3
PROBE = 1000  # queries, sampled by the hash of their key, that tell what is saved
MARGIN = 1e-7  # relative allowance for rounding in the bounds
GROUP_PIVOTS = 20_000  # pivots of all crowded groups together, which every task holds
LEAST_PIVOTS = 8  # a group with fewer is not worth cells


def distances_to(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (
        np.einsum("ij,ij->i", matrix, matrix)[:, None]
        + np.einsum("ij,ij->i", pivots, pivots)[None, :]
        - 2.0 * (matrix @ pivots.T)
    )
    return np.sqrt(np.maximum(sq, 0.0))


def possible_cells(
    dist: np.ndarray, radius: np.ndarray, reach: np.ndarray, between: np.ndarray, scale: float
) -> np.ndarray:
    """(queries x cells) mask of the cells that may hold one of the k nearest rows.

    ``dist``: query to pivot.  ``radius``: pivot to its farthest row, negative for an empty
    cell.  ``reach``: radius that holds k rows.  ``between``: pivot to pivot.
    """
    upper = (dist + reach[None, :]).min(axis=1)
    own = dist.argmin(axis=1)
    nearest = dist[np.arange(len(dist)), own]
    gap = between[own]
    # Rows of a cell are at least as close to its pivot as to the query's own pivot.
    beyond = (dist**2 - nearest[:, None] ** 2) / np.where(gap > 0, 2.0 * gap, np.inf)
    lower = np.maximum(dist - radius[None, :], beyond)
    slack = MARGIN * (scale + np.where(np.isfinite(upper), upper, 0.0))
    return (lower <= (upper + slack)[:, None]) & (radius >= 0)[None, :]


def knn_join_pruned(
    queries: DataFrame,
    base: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vec: str = "v",
    carry: Sequence[str] = (),
    exclude_self: bool = False,
    cells: int | None = None,
    block_rows: int = BLOCK_ROWS,
    worth_share: float = WORTH_SHARE,
) -> DataFrame:
    """(query_id, rank, neighbor_id, sq_dist, carry...), as ``knn_join`` with ``by=None``.

    ``cells`` pivots (a hash sample of the base rows, by default about the square root of their
    number) are held by every task.  A cell that grows beyond ``block_rows``, for instance one
    full of copies, is cut into blocks.  Vectors without structure are the bad case: if the
    queries would still meet more than ``worth_share`` of the base rows, sending them to cells
    only costs more, and all blocks meet (n squared distances) instead.
    """
    base = base.where(finite(F.col(vec))).select(key, vec, *carry)
    queries = queries.where(finite(F.col(vec))).select(key, vec)
    if cells is None:
        cells = min(MAX_CELLS, max(MIN_CELLS, math.isqrt(base.count())))
    rows = bounded_rows(sample_n(base, key, n=cells), cells + 1)
    if not rows:
        return knn_join(queries, base, k, None, key, vec, carry, exclude_self, block_rows)
    pivots = np.array([r[vec] for r in rows], dtype=np.float64)
    wanted = k + 1 if exclude_self else k
    place = StructType([StructField("cell", IntegerType()), StructField("dist", DoubleType())])

    @F.arrow_udf(place)
    def locate(vectors: pa.Array) -> pa.Array:
        cell, dist = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        matrix, step = to_matrix(vectors), max(1, TILE_CELLS // len(pivots))
        for start in range(0, len(matrix), step):
            d = distances_to(matrix[start:start + step], pivots)
            cell[start:start + step] = d.argmin(axis=1)
            dist[start:start + step] = d.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(dist)], ["cell", "dist"])

    located = base.withColumn("_at", locate(F.col(vec))).withColumn("_cell", F.col("_at.cell"))
    by_distance = Window.partitionBy("_cell").orderBy("dist", key)
    reached = (
        located.select("_cell", key, F.col("_at.dist").alias("dist"))
        .withColumn("_n", F.row_number().over(by_distance)).where(F.col("_n") <= wanted)
        .groupBy("_cell").agg(F.max("_n").alias("n"), F.max("dist").alias("reach"))
    )
    farthest = located.groupBy("_cell").agg(F.max("_at.dist").alias("radius"), F.count(F.lit(1)).alias("n"))
    radius, reach = np.full(len(pivots), -1.0), np.full(len(pivots), np.inf)
    counts = np.zeros(len(pivots))
    for r in bounded_rows(farthest, len(pivots)):
        radius[r["_cell"]], counts[r["_cell"]] = r["radius"], r["n"]
    for r in bounded_rows(reached, len(pivots)):
        if r["n"] == wanted:
            reach[r["_cell"]] = r["reach"]
    between = distances_to(pivots, pivots)
    scale = float(np.abs(pivots).max()) + float(radius.max())

    @F.arrow_udf(ArrayType(IntegerType()))
    def choose(vectors: pa.Array) -> pa.Array:
        matrix, step = to_matrix(vectors), max(1, TILE_CELLS // len(pivots))
        sizes, chosen = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(matrix), step):
            d = distances_to(matrix[start:start + step], pivots)
            mask = possible_cells(d, radius, reach, between, scale)
            sizes.append(mask.sum(axis=1))
            chosen.append(np.nonzero(mask)[1])
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(chosen).astype(np.int32)))

    # A look at some queries tells whether pruning pays; either way the result is the same.
    probe = sample_n(queries, key, n=PROBE).select(vec).toArrow()[vec]
    seen = possible_cells(distances_to(to_matrix(probe), pivots), radius, reach, between, scale) @ counts
    if len(seen) and seen.mean() > worth_share * counts.sum():
        return knn_join(queries, base, k, None, key, vec, carry, exclude_self, block_rows)

    sent = queries.withColumn("_cell", F.explode_outer(choose(F.col(vec))))
    partial = knn_join(
        sent, located.drop("_at"), k, "_cell", key, vec, carry, exclude_self, block_rows
    )
    nearest = Window.partitionBy("query_id").orderBy("sq_dist", "neighbor_id")
    return (
        partial.drop("_cell").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    )


class GroupCells:
    """Pivots of crowded groups and what is known of their cells, by the number of the group."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.between = {g: distances_to(p, p) for g, p in pivots.items()}
        self.radius = {g: np.full(len(p), -1.0) for g, p in pivots.items()}
        self.reach = {g: np.full(len(p), np.inf) for g, p in pivots.items()}
        self.counts = {g: np.zeros(len(p)) for g, p in pivots.items()}

    def tiles(self, groups: np.ndarray, vectors: pa.Array):
        """(group, rows, distances to its pivots) for all rows of groups that have pivots."""
        for g in np.unique(groups[groups >= 0]).tolist():
            rows = np.flatnonzero(groups == g)
            matrix, step = to_matrix(vectors.take(pa.array(rows))), max(1, TILE_CELLS // len(self.pivots[g]))
            for start in range(0, len(rows), step):
                yield g, rows[start:start + step], distances_to(matrix[start:start + step], self.pivots[g])

    def possible(self, g: int, dist: np.ndarray) -> np.ndarray:
        scale = float(np.abs(self.pivots[g]).max()) + float(self.radius[g].max())
        return possible_cells(dist, self.radius[g], self.reach[g], self.between[g], scale)


def _group_numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def knn_join_in_cells(
    q: DataFrame, b: DataFrame, crowded: DataFrame, k: int, by: list[str], carry: list[str], exclude_self: bool,
    block_rows: int, worth_share: float = WORTH_SHARE,
) -> DataFrame | None:
    """``knn_join`` of q (by..., query_id, v) and b (by..., neighbor_id, v, carry...) through cells of crowded groups.

    ``crowded`` has (by..., _base_blocks).  Each of these groups gets pivots of its own, drawn by hash, and a query
    goes only to the cells of its group that may hold one of its neighbours; other groups have one cell.
    Groups in which some queries would still meet more than ``worth_share`` of the base rows keep one cell,
    too, and are searched by blocks.  None if no group is worth cells.
    """
    groups = bounded_rows(crowded, GROUP_PIVOTS // LEAST_PIVOTS)
    if not groups:
        return None
    spark, share = b.sparkSession, GROUP_PIVOTS // len(groups)
    kinds = [b.schema[c] for c in by]
    numbered = [(*[r[c] for c in by], n, min(share, max(LEAST_PIVOTS, math.isqrt(r["_base_blocks"] * block_rows)))) for n, r in enumerate(groups)]
    known = spark.createDataFrame(numbered, StructType([*kinds, StructField("_g", IntegerType()), StructField("_pivots", IntegerType())]))

    def with_group(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(known.select(*[F.col(c).alias(c) for c in known.columns])), by, "left")

    base, queries = with_group(b), with_group(q)
    draw = Window.partitionBy("_g").orderBy(uniform(F.col("neighbor_id"), "pivot"), "neighbor_id")
    drawn = base.where("_g is not null").withColumn("_n", F.row_number().over(draw)).where(F.col("_n") <= share).where("_n <= _pivots")
    rows = bounded_rows(drawn.select("_g", "v"), GROUP_PIVOTS)
    cells = GroupCells({g: np.array([r["v"] for r in rows if r["_g"] == g], dtype=np.float64) for g in {r["_g"] for r in rows}})
    place = StructType([StructField("cell", IntegerType()), StructField("dist", DoubleType())])

    @F.arrow_udf(place)
    def locate(groups: pa.Array, vectors: pa.Array) -> pa.Array:
        cell, dist = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        for _, rows, d in cells.tiles(_group_numbers(groups), vectors):
            cell[rows], dist[rows] = d.argmin(axis=1), d.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(dist)], ["cell", "dist"])

    wanted = k + 1 if exclude_self else k
    located = base.withColumn("_at", locate.asNondeterministic()(F.col("_g"), F.col("v")))
    inside = located.where("_g is not null").select("_g", F.col("_at.cell").alias("cell"), F.col("_at.dist").alias("dist"), "neighbor_id")
    inside = cut_lineage(inside)
    nearest_first = Window.partitionBy("_g", "cell").orderBy("dist", "neighbor_id")
    held = inside.withColumn("_n", F.row_number().over(nearest_first)).where(F.col("_n") <= wanted)
    reached = held.groupBy("_g", "cell").agg(F.max("_n").alias("n"), F.max("dist").alias("reach"))
    farthest = inside.groupBy("_g", "cell").agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n"))
    for r in bounded_rows(farthest, GROUP_PIVOTS):
        cells.radius[r["_g"]][r["cell"]], cells.counts[r["_g"]][r["cell"]] = r["radius"], r["n"]
    for r in bounded_rows(reached, GROUP_PIVOTS):
        if r["n"] == wanted:
            cells.reach[r["_g"]][r["cell"]] = r["reach"]
    # A look at some queries of every crowded group tells where cells pay; either way the result is the same.
    probe = queries.where("_g is not null").withColumn(
        "_n", F.row_number().over(Window.partitionBy("_g").orderBy(uniform(F.col("query_id"), "probe"), "query_id"))).where(F.col("_n") <= max(8, PROBE // len(groups)))
    looked = probe.select("_g", "v").toArrow()
    worth = set()
    seen: dict[int, list] = {}
    for g, _, d in cells.tiles(_group_numbers(looked["_g"].combine_chunks()), looked["v"].combine_chunks()) if looked.num_rows else ():
        seen.setdefault(g, []).extend((cells.possible(g, d) @ cells.counts[g]).tolist())
    for g, met in seen.items():
        if np.mean(met) <= worth_share * cells.counts[g].sum():
            worth.add(g)
    if not worth:
        return None
    pays = F.coalesce(F.col("_g").isin(sorted(worth)), F.lit(False))

    @F.arrow_udf(ArrayType(IntegerType()))
    def choose(groups: pa.Array, vectors: pa.Array) -> pa.Array:
        chosen: list = [np.array([-1])] * len(vectors)
        for g, rows, d in cells.tiles(_group_numbers(groups), vectors):
            mask = cells.possible(g, d)
            for i, row in enumerate(rows.tolist()):
                chosen[row] = np.flatnonzero(mask[i])
        offsets = np.r_[0, np.cumsum([len(c) for c in chosen])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int32)))

    sent = queries.withColumn("_cell", F.explode(choose.asNondeterministic()(F.when(pays, F.col("_g")), F.col("v"))))
    there = located.withColumn("_cell", F.when(pays, F.col("_at.cell")).otherwise(F.lit(-1)))
    partial = knn_join(
        sent.select(*by, "_cell", F.col("query_id").alias("_id"), "v"),
        there.select(*by, "_cell", F.col("neighbor_id").alias("_id"), "v", *carry),
        k, [*by, "_cell"], "_id", "v", carry, exclude_self, block_rows, prune=False)
    nearest = Window.partitionBy("query_id").orderBy("sq_dist", "neighbor_id")
    return partial.drop("_cell").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
