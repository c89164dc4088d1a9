"""Neighbour descent, bounded medoids and quantiles by counters: same results, bounded work."""

import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import descent as ds, lineage, representatives as rp
from postloom.operators.descent import _sampled, descend, graph_recall
from postloom.operators.knn import exact_sq_dist, knn_join
from postloom.operators.lineage import Steps
from postloom.operators.profile import describe
from postloom.operators.quantiles import from_bits, ordered_bits, ordered_values, quantiles, select_ranks
from postloom.operators.reduce import knn_graph
from postloom.operators.representatives import group_medoid, medoid_of, weighted_distance_sums
from postloom.operators.totals import Moments, lower_totals, pack, parted
from postloom.registry.base import emb


def vectors(spark, matrix, **columns):
    rows = [(i, [float(x) for x in v], *[c[i] for c in columns.values()]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>" + "".join(f", {n} int" for n in columns))


# --- neighbour descent ---------------------------------------------------------------


@pytest.mark.parametrize("kind", ["blobs", "noise"])
def test_descent_finds_most_neighbours_with_bounded_work(spark, kind):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(3000, 12))
    if kind == "blobs":
        matrix += 20 * rng.normal(size=(30, 12))[rng.integers(0, 30, 3000)]
    df = vectors(spark, matrix).repartition(5).cache()
    found = descend(df, 8, list_size=20, sample=8)
    graph = found.graph.cache()
    assert graph_recall(graph, df, 8, rows=3000) >= 0.95
    assert found.measured < 0.6 * 3000**2 / 2
    assert found.measured <= 3000 * (2 * ds.START_ROWS + found.rounds * 8 * 8**2)
    assert graph.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("d"), F.max("rank").alias("r")).where("n <> 8 or d <> 8 or r <> 8").isEmpty()
    wrong = graph.collect()
    assert all(r.src != r.dst and abs(r.dist - np.linalg.norm(matrix[r.src] - matrix[r.dst])) < 1e-9 for r in wrong[:2000])
    if kind == "noise":
        return
    again = descend(df.repartition(3, "v"), 8, list_size=20, sample=8).graph
    assert again.exceptAll(graph).isEmpty() and graph.exceptAll(again).isEmpty()


def test_descent_on_the_given_vectors(spark):
    df = emb(spark, "/root/testdata/sf0.01")
    graph = knn_graph(df, 10, method="descent").cache()
    assert graph_recall(graph, df, 10, rows=500) >= 0.97


def test_descent_with_copies_hubs_bad_vectors_and_few_rows(spark):
    """A third of all rows are copies; one row is near to everything."""
    rng = np.random.default_rng(1)
    far = rng.normal(size=(400, 6))
    far /= np.linalg.norm(far, axis=1)[:, None]
    matrix = np.vstack([np.zeros((1, 6)), 3 * far, np.ones((200, 6))])
    df = vectors(spark, matrix)
    bad = spark.createDataFrame([(900, None), (901, [float("nan")] * 6), (None, [0.5] * 6)], "vec_id long, v array<double>")
    graph = knn_graph(df.unionByName(bad), 5, method="descent").cache()
    assert graph.count() == 601 * 5 and graph_recall(graph, df, 5, rows=601) >= 0.95
    copies = sorted(r.dst for r in graph.where("src = 500").collect())
    assert copies == [401, 402, 403, 404, 405] and graph.where("src = 402 and dst = 402").isEmpty()
    few = vectors(spark, rng.normal(size=(3, 4)))
    exact = knn_graph(few, 5)
    assert knn_graph(few, 5, method="descent").select("src", "dst", "rank").exceptAll(exact.select("src", "dst", "rank")).isEmpty()
    assert knn_graph(few.limit(0), 5, method="descent").collect() == []


def test_handed_out_links_are_bounded_both_ways(spark):
    hub = spark.createDataFrame([(i, 0, 1.0, True) for i in range(1, 500)], "node long, near long, sq_dist double, fresh boolean")
    assert _sampled(hub, 7, 1).count() == 7
    assert "WindowGroupLimit" in _sampled(hub, 7, 1)._jdf.queryExecution().executedPlan().toString()


def test_graph_methods(spark):
    with pytest.raises(ValueError, match="unknown method"):
        knn_graph(vectors(spark, np.eye(2)), method="other")
    with pytest.raises(ValueError, match="whole table"):
        knn_graph(vectors(spark, np.eye(2)), by="v", method="descent")


# --- medoids -------------------------------------------------------------------------


def shapes():
    rng = np.random.default_rng(0)
    yield "noise", rng.normal(size=(3000, 64))
    yield "blob", np.vstack([rng.normal(size=(2500, 8)), 9 + rng.normal(size=(500, 8))])
    yield "far from zero", 1e4 + rng.normal(size=(800, 5))
    yield "line", np.arange(700.0)[:, None] ** 2
    yield "circle", np.column_stack([np.cos(np.arange(600)), np.sin(np.arange(600))])
    yield "copies", np.vstack([np.zeros((300, 3)), rng.integers(0, 3, (300, 3))]).astype(float)


@pytest.mark.parametrize("name,matrix", list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_lower_totals_are_lower_and_the_winner_is_the_same(name, matrix):
    rng = np.random.default_rng(5)
    weight = rng.integers(1, 4, len(matrix)).astype(float)
    exact = weighted_distance_sums(matrix, matrix, weight)
    for parts in (1, 4):
        lower = lower_totals(matrix, parted(matrix, weight, parts))
        assert (lower <= exact * (1 + 1e-12)).all()
    assert np.allclose(pack(matrix[:9], weight[:9], matrix[0]) + pack(matrix[9:], weight[9:], matrix[0]), pack(matrix, weight, matrix[0]))
    best, total, measured = medoid_of(matrix, weight, np.arange(len(matrix)))
    rounded = exact.round(9)
    assert best == int(np.flatnonzero(rounded == rounded.min())[0]) and math.isclose(total, exact.min(), rel_tol=1e-12)
    if name in ("noise", "blob"):
        assert measured < 0.15 * len(matrix)


@pytest.mark.parametrize("block_rows", [50_000, 300])
def test_medoids_of_groups_with_and_without_blocks(spark, block_rows, monkeypatch):
    rng = np.random.default_rng(2)
    matrix = np.vstack([rng.normal(size=(1500, 6)), 5 + rng.normal(size=(200, 6)), np.zeros((400, 6))])
    group = [0 if i < 1400 else 1 + i % 2 for i in range(2100)]
    measured = []
    plain = rp._totals_of

    def watched(chosen, blocks, by, key):
        measured.append(chosen.count())
        return plain(chosen, blocks, by, key)

    monkeypatch.setattr(rp, "_totals_of", watched)
    got = {r.cluster: r for r in group_medoid(vectors(spark, matrix, cluster=group), "cluster", block_rows=block_rows).collect()}
    for c in range(3):
        rows = np.flatnonzero(np.array(group) == c)
        totals = weighted_distance_sums(matrix[rows], matrix[rows], np.ones(len(rows))).round(9)
        assert got[c].vec_id == rows[np.flatnonzero(totals == totals.min())[0]]
        assert got[c].n == len(rows) and math.isclose(got[c].total, totals.min(), rel_tol=1e-9)
    if block_rows == 300:
        assert 3 <= sum(measured) < 800


# --- quantiles -----------------------------------------------------------------------


def test_bits_keep_the_order(spark):
    values = [-math.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e9, math.inf, math.nan]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None), (98, -0.0)], "i int, x double")
    bits = {r.i: r.b for r in rows.select("i", ordered_bits(F.col("x")).alias("b")).collect()}
    ordered = [bits[i] for i in range(len(values))]
    assert ordered == sorted(ordered) and len(set(ordered)) == len(ordered) and bits[99] is None and bits[98] == bits[4]
    assert [from_bits(b) for b in ordered[:-1]] == values[:-1] and math.isnan(from_bits(ordered[-1]))


def test_quantiles_same_as_percentile(spark):
    rng = np.random.default_rng(4)
    mixed = [None if i % 11 == 0 else float(x) for i, x in enumerate(np.r_[rng.normal(size=400) * 10.0 ** rng.integers(-8, 9, 400), np.full(300, 3.25), [-1e308, 1e308]])]
    rows = [(x, i % 7, None, i) for i, x in enumerate(mixed)]
    df = spark.createDataFrame(rows, "x double, small int, empty float, `a.b` long").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, ["x", "small", "empty", "a.b"], shares)
    want = df.agg(*[F.percentile(F.col(f"`{c}`"), shares).alias(str(i)) for i, c in enumerate(["x", "small", "a.b"])]).first()
    assert got == {"x": want[0], "small": want[1], "empty": [None] * 7, "a.b": want[2]}
    assert select_ranks(ordered_values(df, ["small"]), {0: [0, 701]}) == {0: {0: 0.0, 701: 6.0}}


def test_describe_holds_no_column_in_one_task(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    out = describe(df, ["x"])
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    d = out.first()
    assert (d["count"], d["min"], d["q25"], d["q50"], d["q75"], d["max"]) == (1000.0, 0.0, 24.75, 49.5, 74.25, 99.0)
    assert out.columns == ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    none = describe(df.limit(0), ["x"]).first()
    assert none["count"] == 0 and none["q50"] is None


def test_exact_mode_is_unchanged(spark):
    df = emb(spark, "/root/testdata/sf0.001").limit(60)
    near = knn_join(df, df, k=3, by=None, carry=(), exclude_self=True)
    assert near.select("query_id", "neighbor_id", "rank").exceptAll(knn_graph(df, 3).select("src", "dst", "rank")).isEmpty()


def test_moments_of_nothing():
    assert lower_totals(np.ones((2, 3)), [Moments.of(np.zeros((0, 3)), np.zeros(0), np.zeros(3))]).tolist() == [0, 0]


# --- cells inside of groups ----------------------------------------------------------


def test_a_crowded_cluster_does_not_meet_itself_whole(spark, monkeypatch):
    """One cluster holds half the rows and has structure of its own; a third of it are copies of one vector."""
    from postloom.operators import knn as kn

    rng = np.random.default_rng(6)
    blobs = 30 * rng.normal(size=(40, 8))[rng.integers(0, 40, 1400)] + rng.normal(size=(1400, 8))
    matrix = np.vstack([blobs, np.repeat(blobs[:1], 600, axis=0), rng.normal(size=(2000, 8))])
    cluster = [7] * 2000 + [i % 10 - 12 for i in range(2000)]
    base = vectors(spark, matrix, cluster=cluster, subcategory=[i % 5 for i in range(4000)]).repartition(4)
    some = base.where("vec_id % 5 = 0")
    met = []
    plain = kn.crowded_groups

    def watched(rows, by, **sides):
        if "_cell" in by:
            n = {s: {tuple(r[:-1]): r[-1] for r in d.groupBy(*by).count().collect()} for s, d in sides.items()}
            met.append(sum(c * n["query"].get(g, 0) for g, c in n["base"].items() if g[0] == 7))
        return plain(rows, by, **sides)

    monkeypatch.setattr(kn, "crowded_groups", watched)
    pick = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "neighbor_id", "subcategory", F.round("sq_dist", 9)).collect())
    got = pick(knn_join(some, base, k=4, block_rows=300, exclude_self=True))
    assert got == pick(knn_join(some, base, k=4, block_rows=300, exclude_self=True, prune=False))
    assert len(met) == 1 and met[0] < 0.45 * 400 * 2000
    assert got == pick(knn_join(some.repartition(3), base.repartition(9), k=4, exclude_self=True))


def test_a_crowded_cluster_without_structure_keeps_its_blocks(spark):
    base = vectors(spark, np.random.default_rng(0).normal(size=(400, 40)), cluster=[1] * 400, subcategory=[0] * 400)
    near = knn_join(base, base, k=2, block_rows=50, exclude_self=True)
    assert "_cell" not in near._jdf.queryExecution().analyzed().toString() and near.count() == 800


def test_old_links_do_not_meet_again(spark):
    """Only nodes where something new meets are visited, and only links are written: vectors move at the meeting."""
    links = spark.createDataFrame([(1, 2, True), (1, 3, False), (4, 5, False), (4, 6, False)], "node long, near long, fresh boolean")
    guests = ds._guests(links)
    assert guests.columns == ["at", "node", "fresh"]
    assert sorted(map(tuple, guests.collect())) == [(1, 2, True), (1, 3, False), (2, 1, True)]


def test_rounds_leave_nothing_but_the_nodes_and_the_last_lists(spark, monkeypatch):
    plain, folders = lineage._written, []

    def watched(df):
        folder, table = plain(df)
        folders.append(folder.removeprefix("file:"))
        return folder, table

    monkeypatch.setattr(lineage, "_written", watched)
    found = descend(vectors(spark, np.random.default_rng(7).normal(size=(300, 6))), 4, list_size=8, sample=4, rounds=2)
    assert found.rounds == 2 and len(folders) > 8 and sum(map(os.path.exists, folders)) == 2
    assert found.graph.count() == 1200


def test_what_a_step_shuffled_is_deleted_with_it(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in disk.getAllFiles().mkString(" ").split() if "/shuffle_" in name}

    before, steps = shuffled(), Steps(spark)
    kept = steps.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and kept.count() == 7
    assert spark.conf.get(Steps.CLEANUP) == "false"
    steps.keep_only()
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        kept.count()


def test_a_vector_moves_once_to_every_part_where_it_meets(spark):
    nodes = vectors(spark, np.random.default_rng(8).normal(size=(60, 3))).withColumnRenamed("vec_id", "node")
    meetings = spark.createDataFrame([(i, i % 2, [j for j in range(60) if j != i], 59) for i in range(60)], "at long, part int, rows array<long>, fresh int")
    ends = nodes.select("node", F.lit(None).cast("double").alias("end"))
    seated = ds._seated(meetings, nodes, ends, F.lit(0))
    assert seated.where("v is not null").count() == 2 * 60 and seated.where("rows is not null").count() == 60
    found = ds._nearer(seated, 2, 60, 5)
    assert sum(len(r.node) for r in found.collect()) == 2 * 60 * 5  # a list of each part for each row, not a row per pair


def test_vectors_are_dealt_to_more_parts_only_where_a_task_cannot_hold_them():
    assert ds._parts(600_000, 60_000_000, 700_000, 12) == 12 == ds._parts(10, 0, 1, 12)
    parts = ds._parts(6_000_000, 600_000_000, 700_000, 12)
    assert 600 < parts < 1000 and 6_000_000 * -math.expm1(-100 / parts) <= 700_000


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1.0, 1e6), (1e-9, 1e3), (1e-20, 0.0), (1e20, 0.0)])
@pytest.mark.parametrize("number", [np.float32, np.float64])
def test_pairs_that_meet_are_measured_wherever_numbers_lie(scale, shift, number):
    """Against all pairs one by one: whatever may enter a list is found, with its exact distance."""
    rng = np.random.default_rng(11)
    matrix = (shift + scale * rng.normal(size=(40, 7))).astype(number)
    wide = matrix.astype(np.float64)
    exact = exact_sq_dist(wide, wide, *np.divmod(np.arange(1600), 40)).reshape(40, 40)
    end = np.where(np.arange(40) % 5 == 0, np.inf, np.sort(exact, axis=1)[:, 6])  # a distance that some row has
    met = [rng.permutation(40)[:n] for n in (12, 3, 25, 2)]
    new = [5, 3, 1, 1]
    wanted = set()
    for rows, first in zip(met, new):
        wanted |= {(i, j) for a, i in enumerate(rows) for b, j in enumerate(rows) if a != b and min(a, b) < first and exact[i, j] <= end[i]}
    parts = list(ds._measured(matrix, end, np.concatenate(met).astype(np.int32), np.array([12, 3, 25, 2]), np.array(new, np.int32)))
    node, near, dist = (np.concatenate(x) for x in zip(*parts))
    assert set(zip(node.tolist(), near.tolist())) == wanted
    assert np.allclose(dist, exact[node, near], rtol=1e-12, atol=0)
    node, near, dist = ds._nearest_met(parts, np.arange(40, 0, -1), 2)
    for i in range(40):
        mine = sorted((exact[i, j], -j) for k, j in wanted if k == i)[:2]
        assert [-j for j in near[node == i]] == [j for _, j in mine]
