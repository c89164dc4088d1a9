import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import bounded, evaluate as ev, fewshot as fs, profile as pf, sampling as sa
from postloom.operators.embed import embed_text, embed_tokens, learn_vocabulary, mean_of_windows, token_windows, tokenize
from postloom.operators.labels import label_decode, label_encode, label_vocabulary
from postloom.operators.relational import POST_COLUMNS, drop_noise, enrich, matches, select_mapped
from postloom.plans.classify import classify_clustered, classify_zero_shot
from postloom.plans.prepare import prepare_embeddings, prepare_posts
from postloom.sources import tables as st


# --- joins and projections -----------------------------------------------------------


def test_lookup_duplicates_and_gaps(spark):
    posts = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "z")], "id string, subreddit string")
    lookup = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "w")], "subreddit string, category_1 string")
    got = sorted((r["id"], r["category_1"] or "") for r in enrich(posts, lookup).collect())
    assert got == [("1", "x"), ("1", "y"), ("2", "w"), ("3", "")]


def test_label_numbers_by_range_are_the_same(spark):
    rows = spark.createDataFrame([(f"l{i * 37 % 101:03d}",) for i in range(300)] + [(None,), ("é",), ("Z",)], "x string")
    local = sorted(map(tuple, label_vocabulary(rows, "x").collect()))
    ranged = label_vocabulary(rows, "x", max_labels=1)
    assert sorted(map(tuple, ranged.collect())) == local == [(x, i) for i, x in enumerate(sorted({r[0] for r in rows.collect() if r[0]}))]


def test_small_lookup_is_broadcast(spark, tmp_path):
    spark.createDataFrame([("a", "x")], "subreddit string, category_1 string").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([("1", "a")], "id string, subreddit string").write.parquet(str(tmp_path / "p"))
    joined = enrich(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "l")))
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


def test_select_mapped_keeps_the_order(spark):
    df = spark.createDataFrame([tuple("abcdefghi")], list(reversed(list(POST_COLUMNS))))
    assert select_mapped(df).columns == ["id", "subreddit", "title", "text", "category", "subcategory"]


def test_noise_and_membership(spark):
    df = spark.createDataFrame([(1, -1, [1]), (2, 0, None)], "id int, cluster int, s array<int>")
    assert [r["id"] for r in drop_noise(df).collect()] == [2]
    assert [r[0] for r in df.orderBy("id").select(matches(F.col("s"), F.lit(1))).collect()] == [True, False]


def test_bounded_broadcast(spark):
    df = spark.range(10)
    assert bounded.bounded_rows(df, 9) is None and len(bounded.bounded_rows(df, 10)) == 10
    assert bounded.broadcast_if_small(df, 5) is df
    assert bounded.local_if_small(df, 10)[1] is True


def test_dense_index_is_dense(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    got = sorted(r["i"] for r in bounded.dense_index(df, "k", "i", 4).collect())
    assert got == list(range(4, 5004))


# --- profiles ------------------------------------------------------------------------


def counts_frame(spark, counts):
    return spark.createDataFrame([(f"v{i}",) for i, n in enumerate(counts) for _ in range(n)], "c string")


def test_frequency_shape_small_samples(spark):
    two = pf.frequency_shape(counts_frame(spark, [1, 2]), "c").first()
    three = pf.frequency_shape(counts_frame(spark, [1, 2, 4]), "c").first()
    four = pf.frequency_shape(counts_frame(spark, [1, 2, 4, 9]), "c").first()
    assert two["skewness"] is None and two["kurtosis"] is None
    assert three["skewness"] == pytest.approx(0.9352195) and three["kurtosis"] is None
    assert four["skewness"] == pytest.approx(1.330937732) and four["kurtosis"] == pytest.approx(1.500000000)


def test_describe_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (4, None)], "n int, s string")
    d = pf.describe(df, ["n"]).first()
    assert (d["count"], d["min"], d["q25"], d["q50"], d["q75"], d["max"]) == (3.0, 1.0, 1.5, 2.0, 3.0, 4.0)
    nulls = {r["column"]: (r["nulls"], r["rows"]) for r in pf.profile_nulls(df).collect()}
    assert nulls == {"n": (0, 3), "s": (2, 3)}


def test_count_tokens_on_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["b", "c"],)], "tokens array<string>")
    got = [tuple(r) for r in pf.by_frequency(pf.count_tokens(df)).collect()]
    assert got == [("a", 2), ("b", 2)]


# --- samples, splits, labels ---------------------------------------------------------


def test_random_split_sizes_and_stability(spark):
    df = spark.range(1003)
    a = {r["id"]: r["split"] for r in sa.random_split(df, "id").collect()}
    b = {r["id"]: r["split"] for r in sa.random_split(df.repartition(13), "id").collect()}
    assert a == b
    sizes = {s: list(a.values()).count(s) for s in ("train", "test", "validation")}
    assert sizes == {"train": 802, "test": 100, "validation": 101}
    assert sa.split_sizes(1003) == (802, 100, 101) and sa.split_sizes(10) == (8, 1, 1)


def test_cutoffs_descend_into_crowded_prefixes(spark, monkeypatch):
    monkeypatch.setattr(sa, "FEW_KEYS", 1)
    monkeypatch.setattr(sa, "DIGITS", 1)
    df = spark.range(500)
    got = {r["id"] for r in sa.sample_n(df, "id", n=123).collect()}
    monkeypatch.undo()
    assert got == {r["id"] for r in sa.sample_n(df, "id", n=123).collect()} and len(got) == 123


@pytest.mark.parametrize("n", [0, 1, 99, 100, 200])
def test_sample_sizes(spark, n):
    assert sa.sample_n(spark.range(100), "id", n=n).count() == min(n, 100)


def test_sample_is_map_only(spark):
    plan = sa.sample_n(spark.range(1000), "id", ratio=0.25)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_labels_round_trip_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    vocabulary = label_vocabulary(df, "c")
    assert [tuple(r) for r in vocabulary.orderBy("index").collect()] == [("a", 0), ("b", 1)]
    coded = label_encode(df, "c", vocabulary)
    assert sorted(r["label"] or "" for r in label_decode(coded, "c", vocabulary).collect()) == ["", "a", "b", "b"]
    with pytest.raises(Exception, match="unseen label: z"):
        label_encode(spark.createDataFrame([("z",)], "c string"), "c", vocabulary).collect()


# --- metrics and reports -------------------------------------------------------------


def test_macro_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "d"), ("e", None)]
    m = ev.evaluate(spark.createDataFrame(rows, "truth string, prediction string")).first()
    assert m["accuracy"] == pytest.approx(2 / 6)
    assert m["precision"] == pytest.approx((1 + 1 / 3 + 0 + 0 + 0) / 5)
    assert m["recall"] == pytest.approx((1 / 3 + 1 + 0 + 0 + 0) / 5)
    assert m["f1"] == pytest.approx((0.5 + 0.5 + 0 + 0 + 0) / 5)


def test_reports_with_an_unseen_cluster(spark):
    shape = "id int, category int, cluster int, subcategory int"
    train = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, 5), (3, 0, 0, 6)], shape)
    test = spark.createDataFrame([(7, 0, 0, 5), (8, 0, 0, 9), (9, 0, 1, 5)], shape)
    rows = {r["id"]: r for r in ev.cluster_recall_density(train, test).collect()}
    assert set(rows) == {7, 8}
    assert (rows[7]["hit"], rows[7]["counts"], rows[7]["cluster_size"]) == (True, 2, 3)
    assert rows[7]["proportion"] == pytest.approx(2 / 3) and rows[7]["subcategories"] == [5, 6]
    assert (rows[8]["hit"], rows[8]["counts"], rows[8]["proportion"]) == (False, 0, 0.0)
    quality = {r["cluster"]: (r["recall"], r["density"]) for r in ev.cluster_quality(train, test).collect()}
    assert quality == {0: (0.5, pytest.approx(2 / 3)), 1: (0.0, None)}


def test_unseen_cluster_has_no_prediction(spark):
    shape = "vec_id long, v array<double>, cluster int, subcategory int"
    train = spark.createDataFrame([(1, [0.0], 0, 5)], shape)
    test = spark.createDataFrame([(2, [0.0], 0, 5), (3, [0.0], 1, 5)], shape)
    out = classify_clustered(train, test)
    assert {r["vec_id"]: r["prediction"] for r in out.collect()} == {2: 5, 3: None}
    assert ev.accuracy(out).first()["accuracy"] == 0.5


# --- few-shot ------------------------------------------------------------------------


def few_shot_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(4)), int(s), int(s) // 3) for i, s in enumerate(rng.integers(0, 9, 400))]
    rows += [(1000 + i, 0, 0, 0) for i in range(300)]  # a hot label
    return spark.createDataFrame(rows, "vec_id long, cluster int, subcategory int, category int")


def test_class_weights_sum_to_one(spark):
    sums = fs.class_weights(few_shot_rows(spark)).groupBy("cluster").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 4 and all(r["w"] == pytest.approx(1) for r in sums)


def test_episode_rules(spark):
    rows = few_shot_rows(spark)
    def episodes(df):
        found = fs.few_shot_episodes(df, n_way=2, n_support=2, n_query=3)
        return sorted(found.withColumn("weight", F.round("weight", 9)).collect())

    got = episodes(rows)
    assert got == episodes(rows.repartition(9))
    info = {r["cluster"]: r for r in fs.majority_info(rows, 5).collect()}
    for c in range(4):
        mine = [r for r in got if r["cluster"] == c]
        assert len({r["vec_id"] for r in mine}) == len(mine)
        one = [r for r in mine if r["phase"] == 1]
        two = [r for r in mine if r["phase"] == 2]
        first, second = {r["subcategory"] for r in one}, {r["subcategory"] for r in two}
        assert len(first) == min(2, len(info[c]["major_categories"])) and len(second) == 2 and not first & second
        linked = {s for subs in info[c]["associated_subcategories"].values() for s in subs}
        assert first <= linked
        assert sum(r["role"] == "support" for r in one) == 2 * len(first)
        assert sum(r["role"] == "query" for r in one) == 3 * len(first)
        assert all(r["role"] == "query" for r in two) and len(two) == 3 * len(second)


def test_episode_draw_keeps_few_rows_before_the_shuffle(spark):
    plan = fs.few_shot_episodes(few_shot_rows(spark))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan


def test_cluster_ranges(spark):
    got = [tuple(r) for r in fs.cluster_ranges(few_shot_rows(spark)).orderBy("cluster").collect()]
    assert got[0][1] == 0 and got[-1][2] == 700 and all(a[2] == b[1] for a, b in zip(got, got[1:]))


# --- tokens and embeddings -----------------------------------------------------------


def test_tokenize_limits_and_unknowns(spark):
    df = spark.createDataFrame([("1", "one two three"), ("2", "four one"), ("3", ""), ("4", None)], "id string, text string")
    vocabulary = learn_vocabulary(df.where("id = '1'"))
    ids = {r["token"]: r["token_id"] for r in vocabulary.collect()}
    assert sorted(ids.values()) == [4, 5, 6]
    for bound in (10, 1):
        out = {r["id"]: r for r in tokenize(df, vocabulary, max_length=4, max_vocabulary=bound).collect()}
        assert out["1"]["input_ids"] == [2, ids["one"], ids["two"], 3]
        assert out["2"]["input_ids"] == [2, 1, ids["one"], 3] and out["2"]["attention_mask"] == [1, 1, 1, 1]
        assert out["3"]["input_ids"] == [2, 3] and out["4"]["input_ids"] is None


def test_windows_lose_no_token(spark):
    df = spark.createDataFrame([("1", " ".join(f"w{i}" for i in range(23))), ("2", ""), ("3", None), ("4", "w1 w2 w3 w4")], "id string, text string")
    ids = tokenize(df, learn_vocabulary(df))
    whole = {r["id"]: r["input_ids"] for r in ids.collect()}
    parts: dict = {}
    for r in token_windows(ids, size=6).orderBy("id", "window").collect():
        assert r["input_ids"] is None or (len(r["input_ids"]) <= 6 and r["attention_mask"] == [1] * len(r["input_ids"]))
        parts.setdefault(r["id"], []).append(r["input_ids"])
    assert len(parts["1"]) == 6 and len(parts["4"]) == 1 and parts["3"] == [None] and parts["2"] == [[2, 3]]
    for key, windows in parts.items():
        assert whole[key] is None or [2, *[i for w in windows for i in w[1:-1]], 3] == whole[key]
    over = [r["input_ids"] for r in token_windows(ids.where("id = '1'"), size=6, stride=2).orderBy("window").collect()]
    assert [w[1:3] for w in over[:-1]] == [whole["1"][1 + i:3 + i] for i in range(0, 2 * len(over) - 2, 2)] and over[-1][-2] == whole["1"][-2]


def test_token_model_sees_padded_batches(spark):
    def load():
        def predict(ids, mask):
            assert ids.shape == mask.shape and (ids[mask == 0] == 0).all()
            return np.stack([(ids * mask).sum(1), mask.sum(1)], 1)
        return predict

    df = spark.createDataFrame([("1", "a b c"), ("2", ""), ("3", None)], "id string, text string").coalesce(1)
    rows = {r["id"]: r for r in embed_tokens(tokenize(df, learn_vocabulary(df)), load, batch_size=2).collect()}
    assert rows["1"]["embedding"] == [sum(rows["1"]["input_ids"]), 5] and rows["2"]["embedding"] == [5, 2] and rows["3"]["embedding"] is None
    windows = embed_tokens(token_windows(tokenize(df, learn_vocabulary(df)), size=4), load)
    means = {r["id"]: r["embedding"] for r in mean_of_windows(windows, "id").collect()}
    assert means["1"][1] == pytest.approx((4 * 2 + 3 * 1) / 3) and "3" not in means


def test_embed_with_a_model(spark):
    def load():
        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)
        return predict

    df = spark.createDataFrame([("abc",), ("x",)], "text string")
    got = embed_text(df, make_predict_fn=load, batch_size=1)
    assert sorted(list(r["embedding"]) for r in got.collect()) == [[1.0, 1.0], [3.0, 1.0]]


def test_hashed_embedding_is_unit_or_zero(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    got = [r["embedding"] for r in embed_text(df, dim=16).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1) and np.linalg.norm(got[1]) == 0 and got[2] is None


# --- sources and sinks ---------------------------------------------------------------


def test_delimited_sources(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('id\tsubreddit\ttitle\tselftext\n1\ta\tt\t"say ""hi""\tnow"\n2\tb\t\tx,y\n')
    (tmp_path / "b.tsv").write_text('id\tsubreddit\ttitle\tselftext\n1\ta\tt\t"line one\nline ""two"""\n2\tb\tu\tx\n')
    broken = {r["id"]: r["selftext"] for r in st.read_posts(spark, str(tmp_path / "b.tsv")).collect()}
    assert broken == {"1": 'line one\nline "two"', "2": "x"}
    with pytest.raises(Exception, match="(?i)malformed"):
        st.read_posts(spark, str(tmp_path / "b.tsv"), multiline=False).collect()
    (tmp_path / "l.csv").write_text("subreddit,category_1,category_2,category_3,in_data,reason_for_exclusion\na,c,d,,True,\n")
    posts = {r["id"]: r for r in st.read_posts(spark, str(tmp_path / "p.tsv")).collect()}
    assert posts["1"]["selftext"] == 'say "hi"\tnow' and posts["2"]["title"] is None
    assert st.read_lookup(spark, str(tmp_path / "l.csv")).first()["category_2"] == "d"


def test_splits_round_trip_and_pruning(spark, tmp_path):
    df = sa.hash_split(spark.range(200), "id")
    st.write_splits(df, str(tmp_path / "s"), num_files=6)
    back = st.read_splits(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("id", "split").collect())) == sorted(map(tuple, df.collect()))
    some = st.read_splits(spark, str(tmp_path / "s"), ["train", "test"])
    assert {r["split"] for r in some.collect()} == {"train", "test"}
    assert "PartitionFilters: [split" in some._jdf.queryExecution().toString()


def test_embedding_width_is_checked(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, embedding array<double>").write.parquet(str(tmp_path / "e"))
    with pytest.raises(Exception, match="expected 2 components, found 1"):
        st.read_embeddings(spark, str(tmp_path / "e"), dim=2).collect()


def test_vectors_are_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert st.vectors_or_compute(spark, str(tmp_path / "v"), compute).count() == 3
    assert len(calls) == 1


def test_prototype_index(spark, tmp_path):
    protos = spark.createDataFrame([(0, 5, [1.0], 1), (1, 6, [2.0], 1)], "cluster int, subcategory int, proto array<double>, n long")
    centers = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], "cluster int, centroid array<double>, n long")
    st.build_prototype_index(protos, centers, str(tmp_path))
    one, all_centers = st.read_prototype_index(spark, str(tmp_path), cluster=1)
    assert [r["subcategory"] for r in one.collect()] == [6] and all_centers.count() == 2
    assert "PartitionFilters: [isnotnull(cluster" in one._jdf.queryExecution().toString()


def test_zero_shot_saves_a_usable_model(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in 10 * np.eye(6)[i % 3] + rng.normal(size=6)], i % 3) for i in range(240)]
    df = sa.hash_split(spark.createDataFrame(rows, "vec_id long, v array<double>, subcategory int"), "vec_id")
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    predictions, metrics, model = classify_zero_shot(
        train, test, train_samples_ratio=0.5, model_path=str(tmp_path / "m"), n_clusters=3, n_components=3)
    assert metrics.first()["accuracy"] == 1.0 and predictions.count() == test.count()
    loaded = st.load_model(spark, str(tmp_path / "m"))
    assert loaded.cluster_config == model.cluster_config
    again, _, _ = classify_zero_shot(
        train, test, train_samples_ratio=0.5, model=loaded, work_path=str(tmp_path / "work"))
    assert sorted(again.collect()) == sorted(predictions.collect())
    for load in (st.load_model, st.load_reducer, st.load_kmeans):
        with pytest.raises(FileNotFoundError):
            load(spark, str(tmp_path / "missing"))


def test_preparation_jobs(spark, tmp_path):
    posts = "\n".join(f"p{i}\t{'ab'[i % 2]}\tt{i}\tsome <b> text {i}" for i in range(50))
    (tmp_path / "p.tsv").write_text("id\tsubreddit\ttitle\tselftext\n" + posts + "\n")
    (tmp_path / "b.tsv").write_text('id\tsubreddit\ttitle\tselftext\n1\ta\tt\t"line one\nline ""two"""\n2\tb\tu\tx\n')
    broken = {r["id"]: r["selftext"] for r in st.read_posts(spark, str(tmp_path / "b.tsv")).collect()}
    assert broken == {"1": 'line one\nline "two"', "2": "x"}
    with pytest.raises(Exception, match="(?i)malformed"):
        st.read_posts(spark, str(tmp_path / "b.tsv"), multiline=False).collect()
    (tmp_path / "l.csv").write_text(
        "subreddit,category_1,category_2,category_3,in_data,reason_for_exclusion\na,c1,s1,,,\nb,c2,s2,,,\n")
    out = prepare_posts(spark, str(tmp_path / "p.tsv"), str(tmp_path / "l.csv"), str(tmp_path / "out"))
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {
        "train": 40, "test": 5, "validation": 5}
    assert out.where("id = 'p3'").first()["clean_text"] == "some text 3"
    loose = prepare_posts(spark, str(tmp_path / "p.tsv"), str(tmp_path / "l.csv"), exact=False)
    assert loose.count() == 50
    done = prepare_embeddings(spark, str(tmp_path / "out"), str(tmp_path / "emb"), splits=["train", "test"], num_files=2)
    row = done.where("id = 'p3'").first() or done.first()
    assert done.count() == 45 and len(row["embedding"]) == 64 and row["category"] in (0, 1)
    assert len(row["input_ids"]) == len(row["attention_mask"])


def test_posts_stay_where_they_are_for_a_small_lookup(spark):
    """A computed lookup has no known size; posts with few keys must not be shuffled to it."""
    posts = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("subreddit")).hint("rebalance")
    lookup = spark.range(30).select((F.col("id") % 2).cast("string").alias("subreddit"), F.lit("c").alias("category_1")).distinct()
    got = enrich(posts, lookup)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().sparkPlan().toString()
    assert got.count() == 100 and got.where("category_1 = 'c'").count() == 67
