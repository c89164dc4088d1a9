"""Fitted models of the registered queries: plain joins over the model, and metrics recomputed in SQL."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.functions.text import words
from postloom.functions.vectors import sq_l2
from postloom.operators.cluster import fit_clusters, fit_reducer, get_centroids, predict_clusters, reduce
from postloom.operators.embed import UNKNOWN, _split_places, learn_vocabulary, tokenize
from postloom.operators.graph_reducer import GraphReducerModel
from postloom.operators.reduce import MAX_SUMS, _weighted_mean, graph_transform
from postloom.operators.sampling import sample_n
from postloom.plans.classify import classify_zero_shot
from postloom.registry import QUERIES
from postloom.registry.base import emb
from postloom.sources.tables import load_model, save_model

SF = "/root/testdata/sf0.01"
METRICS = """with l as (select truth label from p union select prediction from p),
  s as (select label, count(*) filter (truth = label and prediction = label) hits, count(*) filter (truth = label) support,
    count(*) filter (prediction = label) predicted from p, l where label is not null group by 1)
  select round(sum(hits) / sum(support), 6), round(avg(case when predicted > 0 then hits / predicted else 0 end), 6),
    round(avg(case when support > 0 then hits / support else 0 end), 6), round(avg(2 * hits / (support + predicted)), 6) from s"""


@pytest.fixture(scope="module")
def fitted(spark):
    rows = emb(spark, SF).cache()
    return rows, fit_clusters(rows.where("split = 'train'"), partitions=8)


def nearest(spark, rows, model):
    """{vec_id: cluster} by a plain join of reduced rows with all centroids."""
    placed = reduce(rows, model.reducer).crossJoin(get_centroids(model, spark))
    order = Window.partitionBy("vec_id").orderBy(sq_l2(F.col("reduced"), F.col("centroid")), "cluster")
    return {r.vec_id: r.cluster for r in placed.withColumn("n", F.row_number().over(order)).where("n = 1").select("vec_id", "cluster").collect()}


@pytest.mark.parametrize("name,split", [("fit_clusters", "train"), ("predict_clusters", "test")])
def test_clusters_are_the_nearest_centroids(spark, fitted, name, split):
    rows, model = fitted
    got = {r.vec_id: r.cluster for r in QUERIES[name](spark, SF).collect()}
    assert got == nearest(spark, rows.where(f"split = '{split}'"), model)


def test_centroids_are_means(spark, fitted):
    rows, model = fitted
    placed = reduce(predict_clusters(rows.where("split = 'train'"), model), model.reducer)
    means = placed.select("cluster", F.posexplode("reduced").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("mean"))
    parts = QUERIES["get_centroids"](spark, SF).join(means, ["cluster", "pos"], "left")
    assert parts.count() == 80 * 50 and parts.where("mean is null or abs(x - mean) > 1e-3").isEmpty()


def plain_graph_coordinates(train, new, k, n_components, iterations, step):
    """NumPy: unit vectors, PCA, fuzzy graph by bisection, averaging; then new points at their neighbours' mean."""
    def strengths(dist):
        positive = dist[dist > 0]
        gap, low, high = np.maximum(dist - (positive.min() if len(positive) else 0), 0), 0.0, 1e6
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-gap / mid).sum() > np.log2(max(len(dist), 2)) else (mid, high)
        return np.exp(-gap / max(mid, 1e-3 * dist.mean(), 1e-12))

    def nearest(v, skip=None):
        dist = np.sqrt(((train - v) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(train)), dist)) if i != skip][:k]
        return order, strengths(dist[order])

    train, new = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (train, new))
    weight = np.zeros((len(train), len(train)))
    for i, v in enumerate(train):
        order, w = nearest(v, i)
        weight[i, order] = w
    weight = weight + weight.T - weight * weight.T
    _, axes = np.linalg.eigh(np.cov(train.T))
    coords = train @ axes[:, ::-1][:, :n_components]
    for _ in range(iterations):
        coords = (1 - step) * coords + step * (weight @ coords) / weight.sum(1, keepdims=True)
    placed = np.array([np.average(coords[o], axis=0, weights=w) for o, w in map(nearest, new)])
    return coords, placed


@pytest.mark.parametrize("graph,step", [("exact", 0.5), ("descent", 0.25)])
def test_graph_reducer_in_fit_save_load_predict(spark, tmp_path, graph, step):
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(4, 6)) * 3
    points = centers[np.arange(120) % 4] + 0.5 * draw.normal(size=(120, 6))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, v array<double>")
    train = rows.where("vec_id < 90").unionByName(spark.createDataFrame([(1000, None), (1001, [float("nan")] * 6)], rows.schema))
    model = fit_clusters(train, n_clusters=4, n_components=3, method="graph", nNeighbors=8, graph=graph, iterations=3, step=step)
    save_model(spark, model, str(tmp_path))
    loaded = load_model(spark, str(tmp_path))
    assert loaded.reducer_config == {"n_components": 3, "method": "graph", "nNeighbors": 8, "graph": graph, "iterations": 3, "step": step}
    stage = loaded.reducer.stages[1]
    assert isinstance(stage, GraphReducerModel) and (stage.getOrDefault("nNeighbors"), stage.getOrDefault("step")) == (8, step)

    # Rows repeat and have a null key; new points and fitted ones come together.
    asked = rows.unionByName(rows.where("vec_id in (3, 100)")).unionByName(spark.createDataFrame([(None, points[5].tolist())], rows.schema))
    got = reduce(asked, loaded.reducer).collect()
    assert len(got) == 123
    coords, placed = plain_graph_coordinates(points[:90], points[90:], 8, 3, 3, step)
    want = np.vstack([coords, placed])
    found = np.array([next(r.reduced for r in got if r.vec_id == i) for i in range(120)])
    signs = np.sign((found[:90] * want[:90]).sum(0))  # PCA axes have no direction
    assert np.abs(found - want * signs).max() < 1e-6
    for i in (3, 100):
        assert len({tuple(r.reduced) for r in got if r.vec_id == i}) == 1
    assert next(r.reduced for r in got if r.vec_id is None) == next(r.reduced for r in got if r.vec_id == 5)
    clusters = {r.vec_id: r.cluster for r in predict_clusters(rows, loaded).collect()}
    assert clusters == {r.vec_id: r.cluster for r in predict_clusters(rows, model).collect()} == nearest(spark, rows, loaded)
    assert all(len({clusters[i] for i in range(c, 120, 4)}) == 1 for c in range(4))


def test_graph_reducer_options(spark):
    rows = spark.createDataFrame([(1, None)], "vec_id long, v array<double>")
    with pytest.raises(ValueError, match="no rows"):
        fit_reducer(rows, method="graph")
    for options in ({"method": "other"}, {"nNeighbors": 3}):
        with pytest.raises(ValueError, match="choose"):
            fit_reducer(rows, **options)


def test_graph_clusters_of_the_query(spark):
    got = QUERIES["predict_clusters_graph"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.vec_id for r in got) == sorted(r.vec_id for r in emb(spark, "/root/testdata/sf0.001").select("vec_id").collect())
    assert all(r.cluster is not None for r in got)


def metrics_of(rows):
    con = duckdb.connect()
    con.execute("create table p(truth int, prediction int)")
    con.executemany("insert into p values (?, ?)", [(r.truth, r.prediction) for r in rows])
    return con.execute(METRICS).fetchone()


def test_zero_shot_votes_and_metrics(spark):
    rows = emb(spark, SF)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    _, _, model = classify_zero_shot(train, test, partitions=8)
    base = predict_clusters(sample_n(train, "vec_id", ratio=0.25, seed=42), model)
    near = predict_clusters(test, model).alias("q").join(base.alias("b"), F.col("q.cluster") == F.col("b.cluster")).select(
        F.col("q.vec_id"), F.col("b.vec_id").alias("other"), F.col("b.subcategory"), sq_l2(F.col("q.v"), F.col("b.v")).alias("d"))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "other"))).where("r <= 5")
    sums = ranked.groupBy("vec_id", "subcategory").agg(F.sum(1 / (F.col("d") + 1e-5)).alias("s"), F.min("r").alias("r"))
    first = sums.withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "r"))).where("n = 1")
    want = {r.vec_id: r.subcategory for r in first.collect()}
    got = QUERIES["classify_zero_shot"](spark, SF).collect()
    assert len(got) == test.count() and {r.vec_id: r.prediction for r in got if r.prediction is not None} == want
    assert (got[0].accuracy, got[0].precision, got[0].recall, got[0].f1) == metrics_of(got)


def test_category_metrics(spark):
    got = QUERIES["category_classifier"](spark, SF).collect()
    assert len(got) > 50 and len({(r.accuracy, r.precision, r.recall, r.f1) for r in got}) == 1
    assert (got[0].accuracy, got[0].precision, got[0].recall, got[0].f1) == metrics_of(got)
    assert got[0].accuracy > 0.5


def test_a_token_in_every_row_is_not_joined(spark):
    """Hot tokens are looked up in their rows; only places of other tokens move by token."""
    rows = [(i, "the " * 5 + f"word{i} the rare{i % 3} zzz") for i in range(300)] + [(300, ""), (301, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    vocabulary = learn_vocabulary(df).where("token <> 'zzz'")
    plain = {r.id: r.input_ids for r in tokenize(df, vocabulary).collect()}
    split = tokenize(df, vocabulary, max_vocabulary=1, hot_rows=200)
    assert {r.id: r.input_ids for r in split.collect()} == plain and UNKNOWN in plain[0]
    _, rare = _split_places(df, vocabulary, words(F.col("text")), "id", 200)
    assert sorted({r.token for r in rare.select("token").distinct().collect()} & {"the", "zzz", "rare0"}) == ["rare0"]
    assert rare.count() == 600 and rare.groupBy("token").count().agg(F.max("count")).first()[0] == 100


def test_a_token_moves_once_per_chunk(spark):
    """Not once per place; repeated and null keys keep their rows, and the vocabulary is learned once."""
    rows = [(i % 7 if i % 5 else None, "the " * 50 + f"word{i % 40} the zzz") for i in range(200)] + [(1, ""), (None, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    vocabulary = learn_vocabulary(df).where("token <> 'zzz'")
    want = sorted(map(repr, tokenize(df, vocabulary).select("id", "text", "input_ids", "attention_mask").collect()))
    for hot_rows in (20, 100_000):
        got = tokenize(df, vocabulary, max_vocabulary=1, hot_rows=hot_rows)
        assert sorted(map(repr, got.select("id", "text", "input_ids", "attention_mask").collect())) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Aggregate \[_chunk#\d+, token#\d+\]", plan) and plan.count("regexp_extract_all") == 2


def test_graph_means_are_summed_in_flat_rows(spark):
    """By component, as the vector aggregate gives them; coordinates of neighbours are fetched after the search."""
    draw = np.random.default_rng(8)
    rows = [(int(i), float(w), p.tolist()) for i, w, p in zip(draw.integers(0, 200, 900), draw.random(900), draw.normal(size=(900, 5)))]
    sent = spark.createDataFrame([*rows, (None, 1.0, [1.0] * 5)], "dst long, weight double, _coords array<double>").repartition(4)
    flat, wide = _weighted_mean(sent, "dst", 5), _weighted_mean(sent, "dst", MAX_SUMS + 1)
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "HashAggregate" in plan
    got, want = ({r.dst: r["_mean"] for r in x.collect()} for x in (flat, wide))
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-12, atol=1e-14) for i in want)


def test_new_points_with_repeated_fitted_keys(spark):
    """A fitted key that comes twice, or is null, counts as often as it comes."""
    draw = np.random.default_rng(2)
    base = [(i // 2 if i > 3 else None, p.tolist(), c.tolist()) for i, (p, c) in enumerate(zip(draw.normal(size=(40, 3)), draw.normal(size=(40, 2))))]
    base += base[:10]
    frame = spark.createDataFrame(base, "vec_id long, v array<double>, reduced array<double>")
    new = spark.createDataFrame([(7, [0.1, 0.2, -0.3]), (8, [1.0, 0.0, 0.0])], "vec_id long, v array<double>")
    got = graph_transform(new, frame, 6)
    assert "_place" in got._jdf.queryExecution().analyzed().toString()
    got = {r.vec_id: r.reduced for r in got.collect()}
    for r in new.collect():
        dist = np.sqrt(((np.array([p for _, p, _ in base]) - r.v) ** 2).sum(1))
        near = np.argsort(dist, kind="stable")[:6]
        one = dist[near][dist[near] > 0].min()
        gap, low, high = np.maximum(dist[near] - one, 0), 0.0, 1e6
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-gap / mid).sum() > np.log2(6) else (mid, high)
        weight = np.exp(-gap / max(mid, 1e-3 * dist[near].mean()))
        assert np.allclose(got[r.vec_id], np.average(np.array([c for _, _, c in base])[near], axis=0, weights=weight), rtol=1e-6)
