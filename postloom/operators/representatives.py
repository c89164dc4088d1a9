"""One representative vector per group: the mean or the medoid."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from postloom.functions.vectors import finite
from postloom.operators.blocks import BLOCK_ROWS, crowded_groups, every_block, own_block, with_block_count
from postloom.operators.bounded import broadcast_if_small
from postloom.operators.knn import TILE_CELLS, exact_sq_dist, to_matrix
from postloom.operators.lineage import cut_lineage
from postloom.operators.totals import Moments, lower_totals, pack, parted

TYPES = ("mean", "centroid", "medoid")
FIRST = 64  # rows of a group that are measured first
PARTS = 4  # parts of a group that are bounded one by one


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def group_mean(df: DataFrame, by: str | Sequence[str], vec: str = "v") -> DataFrame:
    """(by..., representative, n): component-wise mean, combined on the map side."""
    vector = array_to_vector(F.col(vec).cast("array<double>"))
    return (
        df.where(finite(F.col(vec)))
        .groupBy(*_names(by))
        .agg(Summarizer.mean(vector).alias("_mean"), F.count(F.lit(1)).alias("n"))
        .withColumn("representative", vector_to_array("_mean"))
        .select(*_names(by), "representative", "n")
    )


def weighted_distance_sums(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For every row of ``a`` the weighted sum of Euclidean distances to the rows of ``b``.

    Distances come from a matrix product; pairs so close that rounding would show are
    measured exactly.
    """
    a_norm, b_norm = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    left = np.column_stack([-2.0 * a, a_norm, np.ones(len(a))])
    right = np.ascontiguousarray(np.column_stack([b, np.ones(len(b)), b_norm]).T)
    close = 1e-6 * (a_norm.max(initial=0.0) + b_norm.max(initial=0.0))
    step = max(1, TILE_CELLS // max(1, len(b)))
    sums = np.empty(len(a))
    for start in range(0, len(a), step):
        sq = left[start:start + step] @ right
        rows, cols = np.nonzero(sq <= close)
        sq[rows, cols] = exact_sq_dist(a[start:start + step], b, rows, cols)
        sums[start:start + step] = np.sqrt(sq, out=sq) @ weight
    return sums


def _distinct_members(df: DataFrame, by: list[str], vec: str, key: str) -> DataFrame:
    """Copies of a vector folded into one weighted row, before anything else is shuffled."""
    return (
        df.where(finite(F.col(vec)))
        .groupBy(*by, F.col(vec).alias("v"))
        .agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    )


def _crowded(df: DataFrame, by: list[str], vec: str, block_rows: int):
    # Rows bound the distinct vectors from above; counting them reads the group columns only.
    return crowded_groups(block_rows, by, own=df.where(finite(F.col(vec))))["own"]


def _block_totals(distinct: DataFrame, crowd, by: list[str], key: str) -> DataFrame:
    """Work is done per pair of blocks, each unordered pair once, and leaves one partial sum
    per row and pair: never the pairs themselves."""
    placed = with_block_count(distinct, crowd, by, "_own_blocks").withColumn("_own", own_block(key, "_own_blocks"))
    paired = (
        placed.withColumn("_other", every_block("_own_blocks"))
        .withColumn("_low", F.least("_own", "_other"))
        .withColumn("_high", F.greatest("_own", "_other"))
        .drop("_own_blocks", "_other")
    )
    fields = [f for f in paired.schema.fields if f.name in (*by, key, "copies")]
    schema = StructType([*fields, StructField("total", DoubleType())])

    def partial_sums(pair: pa.Table) -> pa.Table:
        own = pair["_own"].to_numpy()
        low, high = pair["_low"][0].as_py(), pair["_high"][0].as_py()
        matrix, weight = to_matrix(pair["v"]), pair["copies"].to_numpy().astype(np.float64)
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        sums = np.zeros(len(own))
        sums[left] = weighted_distance_sums(matrix[left], matrix[right], weight[right])
        if low != high:
            sums[right] = weighted_distance_sums(matrix[right], matrix[left], weight[left])
        return pa.table({**{f.name: pair[f.name] for f in fields}, "total": pa.array(sums)})

    sums = paired.groupBy(*by, "_low", "_high").applyInArrow(partial_sums, schema)
    if crowd is None:
        return sums
    return sums.groupBy(*by, key).agg(F.sum("total").alias("total"), F.first("copies").alias("copies"))


def total_distances(
    df: DataFrame,
    by: str | Sequence[str],
    vec: str = "v",
    key: str = "vec_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(by..., key, copies, total): per distinct vector of a group the summed distance to all
    members of the group; ``key`` is the lowest key among its copies."""
    by = _names(by)
    return _block_totals(_distinct_members(df, by, vec, key), _crowded(df, by, vec, block_rows), by, key)


def medoid_of(matrix: np.ndarray, weight: np.ndarray, order: np.ndarray) -> tuple[int, float, int]:
    """(row, total, rows measured) of the row with the least summed distance to all rows.

    Rows are measured by rising lower bound, until the next bound is above the least total.  Totals are
    compared to 9 digits; of equal ones the row that is first in ``order`` wins.
    """
    lower = lower_totals(matrix, parted(matrix, weight, PARTS)) if len(matrix) > FIRST else np.zeros(len(matrix))
    by_bound = np.argsort(lower, kind="stable")
    totals, at, step = np.full(len(matrix), np.inf), 0, FIRST
    while at < len(matrix) and (at == 0 or lower[by_bound[at]] <= totals.min() + 1e-8):
        rows = by_bound[at:at + step]
        totals[rows] = weighted_distance_sums(matrix[rows], matrix, weight).round(9)
        at, step = at + len(rows), 2 * step
    tied = np.flatnonzero(totals == totals.min())
    best = int(tied[order[tied].argmin()])
    return best, float(totals[best]), at


def group_medoid(
    df: DataFrame,
    by: str | Sequence[str],
    vec: str = "v",
    key: str = "vec_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(by..., key, representative, n, total): the member with the least total distance.

    The mean distance is the total divided by the group size, so it selects the same row.
    Ties (totals equal to 9 digits) go to the lowest key.

    Only rows are measured whose lower bound (see ``totals``) does not exceed the least total: few,
    unless very many members are as central as the medoid.  Bounds need one pass.
    """
    by = _names(by)
    distinct = _distinct_members(df, by, vec, key)
    crowd = _crowded(df, by, vec, block_rows)
    if crowd is None:
        return _whole_group_medoid(distinct, by, key)
    winners = _bounded_medoid(distinct, crowd, by, key, block_rows)
    members = df.select(*by, key, F.col(vec).alias("representative"))
    return members.join(broadcast_if_small(winners), [*by, key]).select(*by, key, "representative", "n", "total")


def _bounded_medoid(distinct: DataFrame, crowd, by: list[str], key: str, block_rows: int) -> DataFrame:
    """(by..., key, total, n) where groups do not fit one task: bounds and totals are taken per block.

    Each round measures the rows of least lower bound in every group that is still open, eight times as
    many as the round before, against all blocks of the group.
    """
    blocks = with_block_count(distinct, crowd, by, "_own_blocks").withColumn("_block", own_block(key, "_own_blocks"))
    blocks = cut_lineage(blocks)
    moments = _moments(blocks, by)
    lower = cut_lineage(_lower(blocks, moments, by, key))
    rank = Window.partitionBy(*by).orderBy("lower", key)
    sizes = blocks.groupBy(*by).agg(F.sum("copies").alias("n"))
    best, done, step = None, 0, FIRST
    while True:
        ranked = lower if best is None else lower.join(broadcast_if_small(best.select(*by, "total")), by).where("lower <= total + 1e-8").drop("total")
        # The rank of a row among the open ones is its rank among all: bounds rise with it.
        chosen = cut_lineage(ranked.withColumn("_n", F.row_number().over(rank)).where(f"_n > {done} and _n <= {done + step}"))
        if chosen.isEmpty():
            break
        totals = _totals_of(chosen.withColumn("_part", F.floor(F.col("_n") / block_rows)), blocks, by, key)
        found = totals.groupBy(*by).agg(F.min(F.struct(F.round("total", 9).alias("total"), F.col(key))).alias("_best"))
        found = found.select(*by, "_best.*")
        if best is not None:
            found = best.unionByName(found).groupBy(*by).agg(F.min(F.struct("total", key)).alias("_best")).select(*by, "_best.*")
        best, done, step = cut_lineage(found), done + step, 8 * step
    return best.join(sizes, by)


def _moments(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., centre, sums): each group's moments about its mean."""
    centre = blocks.groupBy(*by).agg(_weighted_vector_mean("v", "copies").alias("centre"))
    fields = [f for f in blocks.schema.fields if f.name in by]
    schema = StructType([*fields, StructField("centre", ArrayType(DoubleType())), StructField("sums", ArrayType(DoubleType()))])
    centres = _in_every_block(centre, blocks, by)

    def part(rows: pa.Table, middle: pa.Table) -> pa.Table:
        about = to_matrix(middle["centre"])[0]
        sums = pack(to_matrix(rows["v"]), rows["copies"].to_numpy().astype(np.float64), about)
        return pa.table({**{c: rows[c].take([0]) for c in by}, "centre": pa.array([about]), "sums": pa.array([sums])})

    cell = [*by, "_block"]
    parts = blocks.groupBy(*cell).cogroup(centres.groupBy(*cell)).applyInArrow(part, schema)
    total = Summarizer.metrics("sum").summary(array_to_vector("sums"))["sum"]
    return parts.groupBy(*by).agg(vector_to_array(total).alias("sums"), F.first("centre").alias("centre"))


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new ids, so that both sides of a join may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _in_every_block(rows: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` once for every block of their group."""
    return _fresh(_fresh(blocks.select(*by, "_block").distinct()).join(_fresh(rows), by))


def _weighted_vector_mean(vec: str, weight: str):
    vector = array_to_vector(F.col(vec).cast("array<double>"))
    return vector_to_array(Summarizer.metrics("mean").summary(vector, F.col(weight).cast("double"))["mean"])


def _lower(blocks: DataFrame, moments: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., key, v, lower): a lower bound on every row's total; a block meets its group's moments only."""
    fields = [f for f in blocks.schema.fields if f.name in (*by, key, "v")]
    schema = StructType([*fields, StructField("lower", DoubleType())])

    def bound(rows: pa.Table, group: pa.Table) -> pa.Table:
        whole = Moments.unpack(to_matrix(group["sums"])[0], to_matrix(group["centre"])[0])
        lower = lower_totals(to_matrix(rows["v"]), [whole])
        return pa.table({**{f.name: rows[f.name] for f in fields}, "lower": pa.array(lower)})

    cell = [*by, "_block"]
    return blocks.groupBy(*cell).cogroup(_in_every_block(moments, blocks, by).groupBy(*cell)).applyInArrow(bound, schema)


def _totals_of(chosen: DataFrame, blocks: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., key, total) of chosen rows: every part of them meets every block of the group."""
    fields = [f for f in blocks.schema.fields if f.name in (*by, key)]
    schema = StructType([*fields, StructField("total", DoubleType())])
    cell = [*by, "_block", "_part"]
    left = _in_every_block(chosen, blocks, by)
    right = _fresh(blocks).join(_fresh(chosen.select(*by, "_part").distinct()), by)

    def sums(rows: pa.Table, members: pa.Table) -> pa.Table:
        weight = members["copies"].to_numpy().astype(np.float64)
        found = weighted_distance_sums(to_matrix(rows["v"]), to_matrix(members["v"]), weight) if rows.num_rows else np.zeros(0)
        return pa.table({**{f.name: rows[f.name] for f in fields}, "total": pa.array(found)})

    partial = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(sums, schema)
    return partial.groupBy(*by, key).agg(F.sum("total").alias("total"))


def _whole_group_medoid(distinct: DataFrame, by: list[str], key: str) -> DataFrame:
    """Every group fits one block: its task returns the medoid and nothing else."""
    fields = [f for f in distinct.schema.fields if f.name in (*by, key)]
    names = [f.name for f in fields]
    schema = StructType([
        *fields, StructField("representative", distinct.schema["v"].dataType),
        StructField("n", LongType()), StructField("total", DoubleType()),
    ])

    def medoid(group: pa.Table) -> pa.Table:
        copies = group["copies"].to_numpy()
        order = pc.rank(group[key], tiebreaker="first").to_numpy()
        first, total, _ = medoid_of(to_matrix(group["v"]), copies.astype(np.float64), order)
        row = {c: group[c].take([first]) for c in names}
        return pa.table({
            **row, "representative": group["v"].take([first]),
            "n": pa.array([int(copies.sum())]), "total": pa.array([total]),
        })

    return distinct.groupBy(*by).applyInArrow(medoid, schema)


def representative(
    df: DataFrame,
    by: str | Sequence[str],
    vec: str = "v",
    type: str = "mean",
    key: str = "vec_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(by..., representative, n) by mean, centroid (least summed distance) or medoid
    (least mean distance)."""
    if type == "mean":
        return group_mean(df, by, vec)
    if type in ("centroid", "medoid"):
        found = group_medoid(df, by, vec, key, block_rows)
        return found.select(*_names(by), F.col("representative").cast("array<double>").alias("representative"), "n")
    raise ValueError(f"unknown representative type {type!r}; choose one of {', '.join(TYPES)}")
