import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.functions.vectors import l2_normalize
from postloom.operators import cluster as cl
from postloom.operators import knn
from postloom.operators import reduce as rd
from postloom.operators.knn import exact_sq_dist, knn_join, kth_bound, nearest_in_blocks, nearest_k, rejected
from postloom.operators.pruned import distances_to, knn_join_pruned, possible_cells
from postloom.operators.prototypes import cluster_prototypes, label_prototypes, prototypical_classify
from postloom.operators.representatives import group_mean, group_medoid, representative, total_distances
from postloom.operators.vote import vote_majority, vote_weighted


def frame(spark, vectors, **columns):
    rows = [(i, [float(x) for x in v], *[c[i] for c in columns.values()]) for i, v in enumerate(vectors)]
    kinds = {int: "int", str: "string", float: "double"}
    extra = "".join(f", {n} {kinds[type(c[0])]}" for n, c in columns.items())
    return spark.createDataFrame(rows, f"vec_id long, v array<double>{extra}")


def brute(queries, base, k):
    """{query: [(sq_dist, id), ...]} for lists of (id, cluster, vector)."""
    out = {}
    for qid, qc, q in queries:
        dist = sorted((float(((q - b) ** 2).sum()), bid) for bid, bc, b in base if bc == qc)
        out[qid] = [(round(d, 9), b) for d, b in dist[:k]]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((round(r["sq_dist"], 9), r["neighbor_id"]))
    return out


@pytest.mark.parametrize("block_rows", [50_000, 7])
def test_knn_hot_cluster_with_copies(spark, block_rows):
    """One cluster holds most rows, a third of the rows are copies, ties are everywhere."""
    rng = np.random.default_rng(0)
    base_v = np.vstack([np.zeros((40, 3)), rng.integers(0, 3, (80, 3))]).astype(float)
    base_c = [0 if i < 90 else i % 3 for i in range(120)]
    query_v = rng.integers(0, 3, (30, 3)).astype(float)
    query_c = [i % 4 for i in range(30)]  # cluster 3 has no base rows
    base = frame(spark, base_v, cluster=base_c, subcategory=[i % 5 for i in range(120)])
    queries = frame(spark, query_v, cluster=query_c)
    got = as_dict(knn_join(queries, base, k=5, block_rows=block_rows))
    want = brute([(i, query_c[i], query_v[i]) for i in range(30)], [(i, base_c[i], base_v[i]) for i in range(120)], 5)
    want = {q: d for q, d in want.items() if d}
    assert got == want
    again = as_dict(knn_join(queries.repartition(3), base.repartition(11), k=5, block_rows=block_rows))
    assert again == want


def test_knn_small_group_string_keys_and_self(spark):
    rows = spark.createDataFrame(
        [("b", 1, [0.0]), ("a", 1, [0.0]), ("c", 1, [2.0]), ("d", None, [0.0]), ("e", 1, None)],
        "vec_id string, cluster int, v array<double>",
    )
    got = as_dict(knn_join(rows, rows, k=5, carry=()))
    assert got["c"] == [(0.0, "c"), (4.0, "a"), (4.0, "b")] and "d" not in got and "e" not in got
    graph = rd.knn_graph(rows, 2, by="cluster").orderBy("src", "rank").collect()
    assert [(r["src"], r["dst"], r["rank"]) for r in graph] == [
        ("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2)]


def test_kth_bound_holds():
    rng = np.random.default_rng(9)
    rough = rng.normal(size=(50, 5000))
    exact = np.sort(rough, axis=1)[:, 4]
    bound = kth_bound(rough, 5)
    assert (bound >= exact).all() and ((rough <= bound[:, None]).sum(1) < 30).all()


def test_nearest_k_is_exact_under_cancellation():
    rng = np.random.default_rng(1)
    base = 1e4 + rng.normal(size=(300, 8)) * 1e-3
    queries = base[:20] + 1e-4
    at, near, dist, rank = nearest_k(queries, base, np.arange(300), 5)
    for q in range(20):
        want = sorted((((queries[q] - b) ** 2).sum(), i) for i, b in enumerate(base))[:5]
        assert list(near[at == q]) == [i for _, i in want]
        assert list(rank[at == q]) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("block_rows", [50_000, 9])
def test_pruned_search_is_exact(spark, block_rows):
    """Blobs, a third of the rows copies of one vector, and more neighbours than some cells hold."""
    rng = np.random.default_rng(7)
    v = np.vstack([np.full((60, 3), 5.0), *[20 * np.eye(3)[i] + rng.normal(size=(40, 3)) for i in range(3)]])
    rows = frame(spark, v)
    items = [(i, 0, x) for i, x in enumerate(v)]
    for cells in (1, 12, 500):
        got = as_dict(knn_join_pruned(rows, rows, 4, cells=cells, block_rows=block_rows, worth_share=cells / 500))
        assert got == brute(items, items, 4)


def test_pruning_leaves_cells_out():
    rng = np.random.default_rng(8)
    pivots = 50 * rng.normal(size=(40, 4))
    v = np.repeat(pivots, 20, axis=0) + rng.normal(size=(800, 4))
    d = distances_to(v, pivots)
    cell = d.argmin(1)
    radius = np.array([d[cell == c, c].max(initial=-1.0) for c in range(40)])
    reach = np.array([np.sort(d[cell == c, c])[4] if (cell == c).sum() > 4 else np.inf for c in range(40)])
    mask = possible_cells(d, radius, reach, distances_to(pivots, pivots), 100.0)
    assert mask.sum(1).mean() < 4
    sq = ((v[:, None] - v[None]) ** 2).sum(-1)
    near = np.argsort(sq, axis=1)[:, :5]
    assert mask[np.arange(800)[:, None], cell[near]].all()


def test_knn_plan_has_no_cartesian_product(spark):
    rows = frame(spark, np.eye(4), cluster=[0, 0, 1, 1], subcategory=[0, 1, 2, 3])
    plan = knn_join(rows, rows)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


VOTES = {
    1: [("a", 1.0), ("b", 1.0)],
    2: [("a", 0.1), ("b", 0.2), ("b", 0.2)],
    3: [("a", 0.0), ("b", 0.5), ("b", 0.5), ("b", 0.5), ("b", 0.5)],
    4: [("z", 1.0), ("a", 1.0)],
}


def test_votes(spark):
    rows = [(q, i + 1, label, d) for q, votes in VOTES.items() for i, (label, d) in enumerate(votes)]
    near = spark.createDataFrame(rows, "query_id int, rank int, subcategory string, sq_dist double")
    weighted = {r["query_id"]: r["prediction"] for r in vote_weighted(near).collect()}
    majority = {r["query_id"]: r["prediction"] for r in vote_majority(near).collect()}
    assert weighted == {1: "a", 2: "b", 3: "a", 4: "z"}
    assert majority == {1: "a", 2: "b", 3: "b", 4: "z"}


def brute_medoid(vectors):
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1)).sum(1).round(9)
    return int(np.argmin(d)), d


@pytest.mark.parametrize("block_rows", [50_000, 6])
def test_medoid_hot_group_with_copies(spark, block_rows):
    rng = np.random.default_rng(2)
    v = np.vstack([np.ones((30, 4)), rng.normal(size=(60, 4))])
    group = [0] * 80 + [1] * 9 + [2]
    rows = frame(spark, v, cluster=group)
    got = {r["cluster"]: r for r in group_medoid(rows, "cluster", block_rows=block_rows).collect()}
    for g in (0, 1, 2):
        members = [i for i in range(90) if group[i] == g]
        best, totals = brute_medoid(v[members])
        assert got[g]["vec_id"] == members[best]
        assert got[g]["n"] == len(members)
        assert got[g]["total"] == pytest.approx(totals[best], abs=1e-8)
        assert list(got[g]["representative"]) == list(v[members[best]])
    totals = {(r["cluster"], r["vec_id"]): r["total"] for r in total_distances(rows, "cluster", block_rows=block_rows).collect()}
    _, want = brute_medoid(v[:80])
    assert totals[(0, 0)] == pytest.approx(want[0]) and totals[(0, 79)] == pytest.approx(want[79])


def test_representative_types(spark):
    rows = frame(spark, [[0, 0], [2, 0], [2, 0.5]], cluster=[0, 0, 0])
    assert list(representative(rows, "cluster", type="mean").first()["representative"]) == pytest.approx([4 / 3, 0.5 / 3])
    centroid = representative(rows, "cluster", type="centroid").first()
    assert centroid == representative(rows, "cluster", type="medoid").first()
    assert list(centroid["representative"]) == [2.0, 0.0]
    with pytest.raises(ValueError, match="unknown representative type"):
        representative(rows, "cluster", type="median")
    pair = frame(spark, [[1, 0], [0, 1]], cluster=[0, 0])
    assert group_medoid(pair, "cluster").first()["vec_id"] == 0


def test_normalize(spark):
    rows = frame(spark, [[3, 4], [0, 0]])
    want = [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in rows.orderBy("vec_id").select(l2_normalize(F.col("v"))).collect()] == want
    assert [r[0] for r in cl.normalize_vectors(rows).orderBy("vec_id").select("v").collect()] == want


def test_nearest_centroid_ties_nulls_and_join(spark):
    rows = frame(spark, [[0.0, 0], [1, 0], [5, 5]])
    rows = rows.union(spark.createDataFrame([(3, None)], rows.schema))
    centers = spark.createDataFrame([(4, [2.0, 0.0]), (2, [0.0, 0.0])], "cluster int, centroid array<double>")
    near = {r["vec_id"]: r["cluster"] for r in cl.nearest_centroid(rows, centers).collect()}
    assert near == {0: 2, 1: 2, 2: 4, 3: None}
    joined = {r["vec_id"]: r["cluster"] for r in cl.nearest_centroid(rows, centers, max_centroids=1).collect()}
    assert joined == near


def test_prototypes_with_label_gap(spark):
    support = frame(spark, [[1, 0], [2, 0], [0, 3], [0, 1]], subcategory=[2, 2, 5, 5])
    protos = {r["label"]: list(r["proto"]) for r in label_prototypes(support).collect()}
    assert protos == {2: [1.0, 0.0], 5: [0.0, 1.0]}
    found = prototypical_classify(support, frame(spark, [[9, 1], [1, 9]])).orderBy("query_id").collect()
    assert [r["prediction"] for r in found] == [2, 5]


def blobs(spark):
    rng = np.random.default_rng(3)
    v = np.vstack([10 * np.eye(8)[i] + rng.normal(size=(50, 8)) for i in range(4)])
    return frame(spark, v, subcategory=[i // 50 for i in range(200)])


@pytest.fixture(scope="module")
def fitted(spark):
    rows = blobs(spark)
    return rows, cl.fit_clusters(rows, n_clusters=4, n_components=4)


def test_clusters_recover_blobs(spark, fitted):
    rows, model = fitted
    found = cl.predict_clusters(rows, model)
    pairs = found.select("subcategory", "cluster").distinct().collect()
    assert len(pairs) == 4 and {r["cluster"] for r in pairs} == {0, 1, 2, 3}
    assert cl.get_centroids(model, spark).count() == 4
    assert model.cluster_config == {"n_clusters": 4, "max_iter": 300, "random_state": 42, "partitions": 8}
    assert model.reducer_config == {"n_components": 4}


def test_bad_vectors_leave_the_others_alone(spark):
    nan, inf = float("nan"), float("inf")
    base = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [nan, 0.0], 0), (4, [inf, 0.0], 0), (5, None, 0)], "vec_id int, v array<double>, cluster int")
    queries = spark.createDataFrame([(10, [0.1, 0.0], 0), (11, [0.0, nan], 0), (12, [0.9, 0.0], 0)], "vec_id int, v array<double>, cluster int")
    near = {(r["query_id"], r["neighbor_id"]) for r in knn_join(queries, base, k=2, carry=()).collect()}
    assert near == {(10, 1), (10, 2), (12, 1), (12, 2)}
    assert sorted(r[0] for r in rejected(base).collect()) == [3, 4, 5]
    centroids = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "cluster int, centroid array<double>")
    for bound in (10, 1):
        found = {r["vec_id"]: r["cluster"] for r in cl.nearest_centroid(base.drop("cluster"), centroids, max_centroids=bound).collect()}
        assert found == {1: 0, 2: 1, 3: None, 4: None, 5: None}
    assert group_medoid(base, "cluster").first()["n"] == 2


def test_ragged_vectors_are_an_error(spark):
    base = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [4.0], 0)], "vec_id int, v array<double>, cluster int").coalesce(1)
    with pytest.raises(Exception, match="vectors of 1 and of 3 components"):
        knn_join(base, base, k=1, carry=()).collect()


def test_clusters_are_computed_once_per_row(spark):
    centroids = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "cluster int, centroid array<double>")
    rows = cl.nearest_centroid(spark.createDataFrame([(1, [0.2], 1), (2, [0.9], 2)], "vec_id int, v array<double>, subcategory int"), centroids)
    plan = rows.where("cluster is not null and cluster < 5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_fit_does_not_depend_on_partitioning(spark, fitted):
    rows, model = fitted
    again = cl.fit_clusters(rows.repartition(5), n_clusters=4, n_components=4)
    a = {r["vec_id"]: r["cluster"] for r in cl.predict_clusters(rows, model).collect()}
    b = {r["vec_id"]: r["cluster"] for r in cl.predict_clusters(rows, again).collect()}
    assert a == b


def test_predict_is_nearest_centre(spark, fitted):
    rows, model = fitted
    reduced = cl.reduce(rows, model.reducer).select("vec_id", F.col("reduced").alias("v"))
    near = cl.nearest_centroid(reduced, cl.get_centroids(model, spark))
    a = {r["vec_id"]: r["cluster"] for r in near.collect()}
    assert a == {r["vec_id"]: r["cluster"] for r in cl.predict_clusters(rows, model).collect()}


def test_more_clusters_than_rows(spark):
    with pytest.raises(ValueError, match="clusters asked"):
        cl.fit_clusters(frame(spark, np.eye(3)), n_clusters=5, n_components=2)


def test_graph_search_is_spread_and_pruned(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(60, 4)) + 30 * c for c in range(8)])
    rows = frame(spark, v)
    graph = rd.knn_graph(rows, 5)
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert {(r["src"], r["dst"]) for r in graph.collect()} == {(i, int(j)) for i in range(len(v)) for j in np.argsort(d[i])[:5]}
    assert knn_join(rows, rows, 5, by=None, carry=(), exclude_self=True).count() == 5 * len(v)


def test_fuzzy_graph_against_numpy(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 3))
    graph = rd.knn_graph(frame(spark, v), 6)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    w = np.zeros((40, 40))
    for i in range(40):
        near = np.argsort(d[i])[:6]
        gap = d[i][near] - d[i][near].min()
        low, high = 1e-9, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-gap / mid).sum() > np.log2(6) else (mid, high)
        w[i, near] = np.exp(-gap / low)
    want = w + w.T - w * w.T
    got = {(r["src"], r["dst"]): r["weight"] for r in rd.fuzzy_graph(graph).collect()}
    assert set(got) == {(i, j) for i in range(40) for j in range(40) if want[i, j] > 0}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
    assert all(got[(a, b)] == got[(b, a)] for a, b in got)


def test_graph_embed_pulls_neighbours_together(spark, fitted):
    rows, model = fitted
    coords = cl.reduce(rows, model.reducer)
    edges = rd.fuzzy_graph(rd.knn_graph(rows, 10))
    moved = rd.graph_embed(coords, edges, iterations=3)

    def spread(df):
        m = df.join(rows.select("vec_id", "subcategory"), "vec_id").collect()
        parts = [np.array([r["reduced"] for r in m if r["subcategory"] == s]) for s in range(4)]
        return sum(p.var(axis=0).sum() for p in parts)

    assert spread(moved) < 0.5 * spread(coords.select("vec_id", "reduced"))
    placed = rd.graph_transform(rows.limit(20), rows.join(moved, "vec_id"), 5)
    assert placed.count() == 20 and len(placed.first()["reduced"]) == 4


def test_prototype_of_every_group(spark):
    rows = frame(spark, np.eye(6), cluster=[0, 0, 0, 1, 1, 1], subcategory=[0, 0, 1, 1, 2, 2])
    for kind in ("mean", "centroid", "medoid"):
        got = cluster_prototypes(rows, kind)
        assert got.columns == ["cluster", "subcategory", "proto", "n"] and got.count() == 4
    assert group_mean(rows, ["cluster"]).count() == 2


def test_small_blocks_move_in_bundles(spark):
    """A row is copied for every bundle of the other side, not for every block of 20 rows."""
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(900, 6))
    matrix[300:600] = matrix[0]  # copies
    matrix[600:] = 1e3 + 1e-3 * matrix[600:]  # far from the others, and near to each other
    rows = spark.createDataFrame([(i, i % 2, v.tolist(), i) for i, v in enumerate(matrix)], "vec_id long, cluster int, v array<double>, subcategory int")
    near = knn_join(rows, rows, k=4, block_rows=20, exclude_self=True, prune=False)
    want = knn_join(rows, rows, k=4, exclude_self=True, prune=False)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, want.collect()))
    plan = near._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"Generate explode\(sequence\(.*_bundles", plan)) == 2


def test_nearest_in_blocks_is_nearest():
    rng = np.random.default_rng(9)
    noise = rng.normal(size=(400, 16))
    for matrix in (noise, np.zeros((400, 16)), np.repeat(noise[:20], 20, 0)):
        order = np.arange(400)
        whole = nearest_k(matrix[:50], matrix, order, 7)
        blocks = nearest_in_blocks(matrix[:50], matrix, order, order % 90, 7)
        assert all(np.array_equal(x, y) for x, y in zip(blocks, whole))


def test_near_rows_far_from_the_origin_are_few(monkeypatch):
    """Estimates are about the mean, so that a common offset does not make every pair a candidate."""
    draw = np.random.default_rng(3)
    base, pairs = draw.normal(size=(3000, 8)) + 1e5, []
    monkeypatch.setattr(knn, "exact_sq_dist", lambda a, b, rows, cols: pairs.append(len(rows)) or exact_sq_dist(a, b, rows, cols))
    at, near, dist, rank = knn.nearest_k(base[:200], base, np.arange(3000), 5)
    gap = ((base[:200, None] - base[None]) ** 2).sum(2)
    assert np.array_equal(near.reshape(200, 5), np.lexsort((np.tile(np.arange(3000), (200, 1)), gap))[:, :5])
    assert np.allclose(dist, np.take_along_axis(gap, near.reshape(200, 5), 1).ravel(), rtol=1e-12, atol=0)
    assert sum(pairs) < 200 * 5 * 4


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e30])
def test_near_rows_of_any_scale_and_density(scale):
    """Rows closer together than single precision can tell are told apart in double precision."""
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(6, 4))
    base = (centers[np.arange(1200) % 6] + 1e-7 * draw.normal(size=(1200, 4)) * (np.arange(1200)[:, None] % 5 > 0)) * scale
    order = draw.permutation(1200)
    at, near, dist, rank = knn.nearest_k(base[:60], base, order, 7)
    gap = (((base[:60, None] - base[None]) / scale) ** 2).sum(2)
    for i in range(60):
        found = near[at == i]
        assert np.allclose(gap[i, found], np.sort(gap[i])[:7], rtol=1e-6, atol=1e-26)


def test_partial_results_of_a_whole_table_move_as_lists(spark):
    """One row per query and base block, not k; repeated keys, ties and carried columns as before."""
    draw = np.random.default_rng(9)
    points = draw.integers(0, 3, (1400, 3)).astype(float)
    keys = [i - i % 50 % 2 for i in range(1400)]
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in zip(keys, points)], "vec_id long not null, v array<double>")
    rows = rows.withColumn("tag", F.concat(F.lit(""), F.col("vec_id").cast("string")))
    queries = spark.createDataFrame([(i, points[i].tolist()) for i in range(1300, 1400)], "vec_id long, v array<double>")
    got = knn_join(queries, rows, 6, None, carry=("tag",), block_rows=500)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "near" in plan and "Window" not in plan
    lists = {}
    for r in got.collect():
        lists.setdefault(r.query_id, []).append((r["rank"], r.sq_dist, r.neighbor_id, r.tag))
    asked = {r.vec_id: np.array(r.v) for r in queries.collect()}
    assert set(lists) == set(asked)
    for i, found in lists.items():
        near = sorted((float(((points[j] - asked[i]) ** 2).sum()), keys[j]) for j in range(1400))[:6]
        assert sorted(found) == [(n + 1, d, k, str(k)) for n, (d, k) in enumerate(near)]
