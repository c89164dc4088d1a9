"""The stored index against the exact join: same rows, unmoved buckets, cells that are not read."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators.knn import knn_join
from postloom.sources.vector_index import append_to_index, build_vector_index, open_vector_index, search_index


def table(spark, matrix, first=0):
    rows = [(first + i, [float(x) for x in v], f"c{i % 3}") for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>, label string")


def pick(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "neighbor_id", "label", F.round("sq_dist", 9)).collect())


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    centres = 40 * rng.normal(size=(25, 6))
    blobs = centres[rng.integers(0, 25, 1500)] + rng.normal(size=(1500, 6))
    base = table(spark, np.vstack([blobs, np.repeat(blobs[:1], 500, axis=0)])).cache()
    queries = table(spark, np.vstack([blobs[::30], blobs[:1], np.zeros((1, 6))]), first=9000).cache()
    return base, queries, centres


def test_same_as_the_exact_join(spark, data, tmp_path):
    base, queries, _ = data
    bad = spark.createDataFrame([(-1, None, "x"), (-2, [float("nan")] * 6, "x")], base.schema)
    path = f"file://{tmp_path}/index"
    index = build_vector_index(base.where("vec_id % 4 < 2").unionByName(bad), path, carry=["label"], buckets=5, block_rows=100)
    index = append_to_index(index, base.where("vec_id % 4 = 2"), block_rows=100)
    append_to_index(index, base.where("vec_id % 4 = 3"))
    again = open_vector_index(spark, path)
    assert again.versions == [0, 1, 2]
    want = pick(knn_join(queries, base, k=4, by=None, carry=["label"]))
    assert pick(search_index(again, queries.unionByName(bad), k=4)) == want
    assert pick(search_index(again, queries, k=4, block_rows=7)) == want
    many = pick(knn_join(queries, base, k=90, by=None, carry=["label"]))
    assert pick(search_index(again, queries, k=90)) == many
    assert search_index(again, queries.limit(0), k=4).collect() == []
    held = [c for c in again.cells() if c["version"] == 0]
    assert sum(c["rows"] for c in held) == base.where("vec_id % 4 < 2").count() and max(c["rows"] for c in held) <= 160


def test_the_index_is_not_moved_and_far_cells_are_not_read(spark, data, tmp_path):
    base, _, centres = data
    index = build_vector_index(base, f"file://{tmp_path}/index", carry=["label"], cells=60, buckets=8)
    near_one = table(spark, centres[:1], first=9000)
    found = search_index(index, near_one, k=3)
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("FlatMapCoGroupsInArrow"):]
    queries_side, index_side = re.split(r"\n\s+\+- Sort \[cell", join, maxsplit=1)
    assert queries_side.count("Exchange") == 1 and "Exchange" not in index_side and "Bucketed: true" in index_side
    visited = re.search(r"SelectedBucketsCount: (\d+) out of 8", plan)
    assert visited and int(visited.group(1)) < 8
    cells = len([c for c in index.cells() if c["rows"]])
    assert "PushedFilters: [In(cell" in plan or "EqualTo(cell" in plan
    assert cells > 20


def test_no_index(spark, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        open_vector_index(spark, f"file://{tmp_path}/nothing")
