"""A stored index of vectors: cells around pivots, bucketed by cell, with bounds that rule cells out.

``data/vN`` holds the rows of version N, bucketed and sorted by cell, so that a search brings its queries
to the buckets and does not move the index.  ``cells/vN`` holds for every cell the pivot, the number of rows,
the radius and the distances of the rows nearest to the pivot.  ``versions/vN`` is written last: a version
without it does not count.  Pivots are drawn once; an append is a new version with the same pivots.
A cell beyond ``block_rows`` rows, such as one full of copies, is kept as several cells around one pivot.
"""

import hashlib
import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from postloom.functions.vectors import finite
from postloom.operators.bounded import bounded_rows
from postloom.operators.knn import BLOCK_ROWS, TILE_CELLS, nearest_k, to_matrix
from postloom.operators.lineage import cut_lineage
from postloom.operators.pruned import MAX_CELLS, MIN_CELLS, distances_to, possible_cells
from postloom.operators.sampling import sample_n

REACH = 64  # distances to the nearest rows that are kept for every cell
BUCKETS = 64


@dataclass
class VectorIndex:
    """A stored index and its versions; ``key`` and ``carry`` are columns of the rows."""

    spark: SparkSession
    path: str
    key: str
    carry: list[str]
    buckets: int
    versions: list[int]

    def cells(self) -> list[dict]:
        """One row per cell and version, of a number that the build bounds."""
        return [r for n in self.versions for r in bounded_rows(self.spark.read.parquet(f"{self.path}/cells/v{n}")) or []]

    def data(self, version: int) -> DataFrame:
        """The bucketed table of a version, under a name of this session; the catalog entry owns no files."""
        at = f"{self.path}/data/v{version}"
        name = f"vector_index_{hashlib.md5(at.encode()).hexdigest()}"
        self.spark.sql(f"drop table if exists {name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(at).schema.fields)
        self.spark.sql(f"create table {name} ({columns}) using parquet clustered by (cell) sorted by (cell) into {self.buckets} buckets location '{at}'")
        return self.spark.table(name)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index at ``path`` with all versions written so far."""
    versions = []
    while _exists(spark, f"{path}/versions/v{len(versions)}/_SUCCESS"):
        versions.append(len(versions))
    if not versions:
        raise ValueError(f"no index at {path}")
    config = json.loads(spark.read.text(f"{path}/versions/v0").first()["value"])
    return VectorIndex(spark, path, config["key"], config["carry"], config["buckets"], versions)


def build_vector_index(
    base: DataFrame, path: str, key: str = "vec_id", vec: str = "v", carry: Sequence[str] = (),
    cells: int | None = None, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS,
) -> VectorIndex:
    """Store ``base``; ``cells`` pivots (about the square root of the rows) are drawn by the hash of the key.

    Rows whose vector is null or not finite are left out.
    """
    rows = base.where(finite(F.col(vec))).select(key, F.col(vec).cast("array<double>").alias("v"), *carry)
    if cells is None:
        cells = min(MAX_CELLS, max(MIN_CELLS, math.isqrt(rows.count())))
    drawn = bounded_rows(sample_n(rows, key, n=cells), cells + 1)
    pivots = np.array([r["v"] for r in drawn], dtype=np.float64)
    return _write(base.sparkSession, rows, path, pivots, 0, {"key": key, "carry": list(carry), "buckets": buckets}, block_rows)


def append_to_index(index: VectorIndex, more: DataFrame, vec: str = "v", block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """Store further rows as the next version, around the same pivots; older versions are not touched."""
    rows = more.where(finite(F.col(vec))).select(index.key, F.col(vec).cast("array<double>").alias("v"), *index.carry)
    first = {r["pivot_id"]: r["pivot"] for r in bounded_rows(index.spark.read.parquet(f"{index.path}/cells/v0"))}
    pivots = np.array([first[i] for i in sorted(first)], dtype=np.float64)
    config = {"key": index.key, "carry": index.carry, "buckets": index.buckets}
    return _write(index.spark, rows, index.path, pivots, len(index.versions), config, block_rows)


def _write(spark, rows: DataFrame, path: str, pivots: np.ndarray, version: int, config: dict, block_rows: int) -> VectorIndex:
    place = StructType([StructField("pivot_id", IntegerType()), StructField("dist", DoubleType())])

    @F.arrow_udf(place)
    def locate(vectors: pa.Array) -> pa.Array:
        at, dist = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        matrix, step = to_matrix(vectors), max(1, TILE_CELLS // max(1, len(pivots)))
        for start in range(0, len(matrix), step):
            d = distances_to(matrix[start:start + step], pivots)
            at[start:start + step], dist[start:start + step] = d.argmin(axis=1), d.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(at), pa.array(dist)], place.names)

    key, carry = config["key"], config["carry"]
    located = cut_lineage(rows.select(key, "v", *carry, locate.asNondeterministic()(F.col("v")).alias("_at")).select(key, "v", *carry, "_at.*"))
    sizes = bounded_rows(located.groupBy("pivot_id").agg(F.count("*").alias("n")), max(1, len(pivots)))
    parts = {r["pivot_id"]: max(1, math.ceil(r["n"] / block_rows)) for r in sizes}
    # All pivots are kept, those without rows too: appends need them.  Cells are numbered pivot by pivot.
    starts, total = [], 0
    for i in range(len(pivots)):
        starts.append((i, total, parts.get(i, 1)))
        total += parts.get(i, 1)
    numbers = spark.createDataFrame(starts, "pivot_id int, first int, parts int")  # a row per pivot
    placed = located.join(F.broadcast(numbers), "pivot_id").withColumn("cell", F.col("first") + F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    placed = cut_lineage(placed.drop("first", "parts"))
    nearest = Window.partitionBy("cell").orderBy("dist", key)
    close = placed.select("cell", "dist", key).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= REACH)
    near = close.groupBy("cell").agg(F.sort_array(F.collect_list("dist")).alias("near"))
    stats = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("dist").alias("radius")).join(near, "cell")
    table = [(c, i, [float(x) for x in pivots[i]]) for i, first, n in starts for c in range(first, first + n)]
    known = spark.createDataFrame(table, "cell int, pivot_id int, pivot array<double>")
    none = F.array().cast("array<double>")
    cells = known.join(stats, "cell", "left").select(
        "cell", "pivot_id", "pivot", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("radius", F.lit(-1.0)).alias("radius"),
        F.coalesce("near", none).alias("near"), F.lit(version).alias("version"))
    cells.write.mode("overwrite").parquet(f"{path}/cells/v{version}")
    name = f"vector_index_write_{uuid.uuid4().hex}"
    # One task per bucket writes one file per bucket, with the hash that the bucketing uses.
    dealt = placed.drop("pivot_id", "dist").repartition(config["buckets"], "cell")
    dealt.write.mode("overwrite").bucketBy(config["buckets"], "cell").sortBy("cell").option("path", f"{path}/data/v{version}").format("parquet").saveAsTable(name)
    spark.sql(f"drop table {name}")  # an external table: its files stay
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/versions/v{version}")
    return open_vector_index(spark, path)


def search_index(index: VectorIndex, queries: DataFrame, k: int = 5, key: str | None = None, vec: str = "v", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, neighbor_id, sq_dist, carry...): the exact k nearest stored rows of every query.

    A query goes to the cells that may hold one of them; other cells are not read.  Ties go to the lower
    key.  Queries without a usable vector have no rows.  Where a cell gets more queries than
    ``block_rows``, they meet it in several passes.
    """
    key = key or index.key
    cells = index.cells()
    queries = queries.where(finite(F.col(vec))).select(F.col(key).alias("query_id"), F.col(vec).cast("array<double>").alias("v"))
    pivots = np.array([c["pivot"] for c in cells], dtype=np.float64)
    radius = np.array([c["radius"] for c in cells])
    # Within the k-th kept distance a cell holds k rows; within its radius it holds all.
    reach = np.array([c["near"][k - 1] if len(c["near"]) >= k else c["radius"] if c["rows"] >= k else np.inf for c in cells])
    distinct, of_cell = np.unique(pivots, axis=0, return_inverse=True)
    between = distances_to(distinct, distinct)
    scale = float(np.abs(pivots).max(initial=0.0)) + float(radius.max(initial=0.0))
    of_cell = of_cell.ravel()
    within = np.column_stack([[c["version"] for c in cells], [c["cell"] for c in cells]]).astype(np.int32)
    place = StructType([StructField("version", IntegerType()), StructField("cell", IntegerType())])

    @F.arrow_udf(ArrayType(place))
    def choose(vectors: pa.Array) -> pa.Array:
        matrix, step = to_matrix(vectors), max(1, TILE_CELLS // len(cells))
        sizes, chosen = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(matrix), step):
            dist = distances_to(matrix[start:start + step], distinct)[:, of_cell]
            mask = possible_cells(dist, radius, reach, between[of_cell][:, of_cell], scale)
            sizes.append(mask.sum(axis=1))
            chosen.append(np.nonzero(mask)[1])
        at = within[np.concatenate(chosen)]
        flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(at[:, i])) for i in range(2)], place.names)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), flat)

    sent = cut_lineage(queries.select("query_id", "v", F.inline(choose.asNondeterministic()(F.col("v")))))
    visits = bounded_rows(sent.groupBy("version", "cell").count(), len(cells))
    passes = max([1, *[math.ceil(r["count"] / block_rows) for r in visits]])
    partial = None
    for version in index.versions:
        visited = sorted(r["cell"] for r in visits if r["version"] == version)
        if not visited:
            continue
        base = index.data(version).where(F.col("cell").isin(visited))
        for n in range(passes):
            mine = sent.where((F.col("version") == version) & (F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n)).drop("version")
            met = _meet(mine, base, k, index)
            partial = met if partial is None else partial.unionAll(met)
    if partial is None:
        return _meet(sent.drop("version"), index.data(0).limit(0), k, index)
    nearest = Window.partitionBy("query_id").orderBy("sq_dist", "neighbor_id")
    return partial.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _meet(queries: DataFrame, base: DataFrame, k: int, index: VectorIndex) -> DataFrame:
    """Partial top-k of every cell: both sides are grouped by the bucketing column only."""
    key, carry = index.key, list(index.carry)
    schema = StructType([
        StructField("query_id", queries.schema["query_id"].dataType), StructField("rank", IntegerType()),
        StructField("neighbor_id", base.schema[key].dataType), StructField("sq_dist", DoubleType()), *[base.schema[c] for c in carry]])

    def nearest(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            at = near = rank = np.zeros(0, np.int64)
            dist = np.zeros(0)
        else:
            order = pc.rank(stored[key], tiebreaker="first").to_numpy()
            at, near, dist, rank = nearest_k(to_matrix(asked["v"]), to_matrix(stored["v"]), order, k)
        return pa.table({
            "query_id": asked["query_id"].take(pa.array(at)), "rank": pa.array(rank.astype(np.int32)),
            "neighbor_id": stored[key].take(pa.array(near)), "sq_dist": pa.array(dist), **{c: stored[c].take(pa.array(near)) for c in carry}})

    return queries.groupBy("cell").cogroup(base.groupBy("cell")).applyInArrow(nearest, schema)
