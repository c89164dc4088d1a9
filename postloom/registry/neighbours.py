"""Vector, neighbour, vote and prototype queries."""

from pyspark.sql import functions as F

from postloom.functions.vectors import inverse_distance_weight, l2, l2_normalize, sq_l2
from postloom.operators.blocks import BLOCK_ROWS
from postloom.operators.cluster import nearest_centroid, normalize_vectors
from postloom.operators.evaluate import accuracy, evaluate
from postloom.operators.knn import knn_join, rejected
from postloom.operators.prototypes import (
    cluster_centroids, cluster_prototypes, label_prototypes, prototype_scores, prototypical_classify,
    routed_search, search_prototypes,
)
from postloom.operators.pruned import knn_join_in_cells, knn_join_pruned
from postloom.operators.reduce import knn_graph
from postloom.operators.representatives import group_mean, group_medoid, total_distances
from postloom.operators.vote import vote_majority, vote_weighted
from postloom.plans.classify import classify_clustered
from postloom.registry.base import (
    emb, emb_clustered, l2_sql, query, r6, scratch, seeds, sq_sql, train_test, unit_sql,
)
from postloom.sources.tables import build_prototype_index, read_prototype_index
from postloom.streaming.batches import classify_stream, read_batches
from postloom.sources.vector_index import append_to_index, build_vector_index, open_vector_index, search_index

_EMB, _CLUSTERED, _KNN, _TRAIN = ("emb",), ("emb_clustered",), ("knn",), ("train",)


def _long(df, vec, *keys):
    return df.select(*keys, F.posexplode_outer(vec).alias("pos", "x")).select(*keys, "pos", r6("x").alias("x"))


def _long_sql(keys, vec, source):
    return (
        f"select {keys}, pos, round(x, 6) x from (select {keys}, unnest({vec}::double[]) x, "
        f"cast(generate_subscripts({vec}, 1) - 1 as int) pos from {source})"
    )


@query("l2_normalize", _long_sql("vec_id", "u", f"(select vec_id, {unit_sql('v')} u from emb)"), _EMB)
def l2_normalize_query(spark, sf_dir):
    return _long(emb(spark, sf_dir).withColumn("u", l2_normalize(F.col("v"))), "u", "vec_id")


@query("normalize_vectors", _long_sql("vec_id", "u", f"(select vec_id, {unit_sql('v')} u from emb)"), _EMB)
def normalize_vectors_query(spark, sf_dir):
    return _long(normalize_vectors(emb(spark, sf_dir), "v", "u"), "u", "vec_id")


@query(
    "centroid_distances",
    f"""select vec_id, e.cluster, round({sq_sql('v', 'centroid')}, 6) sq_dist, round({l2_sql('v', 'centroid')}, 6) dist,
        round(1 / ({sq_sql('v', 'centroid')} + 1e-5), 6) weight
        from emb_clustered e join seeds s on e.cluster = s.cluster""",
    _CLUSTERED,
)
def centroid_distances(spark, sf_dir):
    rows = emb_clustered(spark, sf_dir).join(seeds(spark, sf_dir), "cluster")
    sq = sq_l2(F.col("v"), F.col("centroid"))
    return rows.select("vec_id", "cluster", r6(sq).alias("sq_dist"), r6(l2(F.col("v"), F.col("centroid"))).alias("dist"),
                       r6(inverse_distance_weight(sq)).alias("weight"))


@query("assign_clusters", "select vec_id, cluster from emb_clustered", _CLUSTERED)
def assign_clusters(spark, sf_dir):
    return nearest_centroid(emb(spark, sf_dir), seeds(spark, sf_dir)).select("vec_id", "cluster")


@query("assign_clusters_by_join", "select vec_id, cluster from emb_clustered", _CLUSTERED)
def assign_clusters_by_join(spark, sf_dir):
    """The way beyond the broadcast bound."""
    found = nearest_centroid(emb(spark, sf_dir), seeds(spark, sf_dir), max_centroids=1)
    return found.select("vec_id", "cluster")


def neighbours(spark, sf_dir, block_rows=BLOCK_ROWS, prune=True):
    train, test = train_test(spark, sf_dir)
    return knn_join(test, train, k=5, block_rows=block_rows, prune=prune)


_KNN_SQL = "select cluster, query_id, rank, neighbor_id, round(sq_dist, 6) sq_dist, subcategory from knn"


@query("knn_topk", _KNN_SQL, _KNN)
def knn_topk(spark, sf_dir):
    return neighbours(spark, sf_dir).withColumn("sq_dist", r6("sq_dist"))


@query("knn_topk_blocks", _KNN_SQL, _KNN)
def knn_topk_blocks(spark, sf_dir):
    """The same with groups cut into small blocks, as for hot clusters."""
    return neighbours(spark, sf_dir, block_rows=20, prune=False).withColumn("sq_dist", r6("sq_dist"))


@query("knn_topk_cells", _KNN_SQL, _KNN)
def knn_topk_cells(spark, sf_dir):
    """The same through cells inside of crowded clusters, whatever they save."""
    train, test = train_test(spark, sf_dir)
    q = test.select("cluster", F.col("vec_id").alias("query_id"), "v")
    b = train.select("cluster", F.col("vec_id").alias("neighbor_id"), "v", "subcategory")
    crowded = train.groupBy("cluster").agg(F.ceil(F.count("*") / 20).cast("int").alias("_base_blocks")).where("_base_blocks > 1")
    near = knn_join_in_cells(q, b, crowded, 5, ["cluster"], ["subcategory"], False, 20, worth_share=1.0)
    return near.withColumn("sq_dist", r6("sq_dist"))


_BAD = "vec_id % 17 = 0"


@query(
    "knn_with_rejected",
    f"""select vec_id query_id, 0 rank, null neighbor_id from emb where {_BAD}
    union all select query_id, rank, neighbor_id from (
      select q.vec_id query_id, b.vec_id neighbor_id, cast(row_number() over (partition by q.vec_id order by {sq_sql('q.v', 'b.v')}, b.vec_id) as int) rank
      from (select * from test where not {_BAD}) q join (select * from train where not {_BAD}) b on q.cluster = b.cluster) where rank <= 5""",
    ("train", "test"),
)
def knn_with_rejected(spark, sf_dir):
    """Some vectors hold a NaN or an infinity: they are listed, all other rows keep their results."""
    bad = F.when(F.col("vec_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))).cast("float")
    vec = F.when(F.expr(_BAD), F.transform("v", lambda x, i: F.when(i == 3, bad).otherwise(x))).otherwise(F.col("v"))
    rows = nearest_centroid(emb(spark, sf_dir).withColumn("v", vec), seeds(spark, sf_dir))
    near = knn_join(rows.where("split = 'test'"), rows.where("split = 'train'"), k=5)
    none = rejected(rows).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("neighbor_id"))
    return none.unionByName(near.select("query_id", "rank", "neighbor_id"))


@query(
    "vote_weighted",
    """select query_id, subcategory prediction, round(s, 6) votes from (select *, row_number() over
       (partition by query_id order by s desc, r) rk from (select query_id, subcategory,
       sum(1/(sq_dist+1e-5)) s, min(rank) r from knn group by all)) where rk = 1""",
    _KNN,
)
def vote_weighted_query(spark, sf_dir):
    return vote_weighted(neighbours(spark, sf_dir)).withColumn("votes", r6("votes"))


@query(
    "vote_majority",
    """select query_id, subcategory prediction, s votes from (select *, row_number() over
       (partition by query_id order by s desc, r) rk from (select query_id, subcategory,
       count(*) s, min(rank) r from knn group by all)) where rk = 1""",
    _KNN,
)
def vote_majority_query(spark, sf_dir):
    return vote_majority(neighbours(spark, sf_dir))


@query("classify_clustered", "select vec_id, cluster, truth, prediction from predictions", ("predictions",))
def classify_clustered_query(spark, sf_dir):
    return classify_clustered(*train_test(spark, sf_dir))


@query("classify_stream", "select vec_id, cluster, truth, prediction from predictions", ("predictions",))
def classify_stream_query(spark, sf_dir):
    """The same for test rows that arrive in files, several batches of them."""
    train, test = train_test(spark, sf_dir)
    root = scratch(spark)
    test.repartition(3, "vec_id").write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    classify_stream(arriving, train, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return read_batches(spark, f"{root}/out").drop("batch")


@query(
    "accuracy",
    """select count(*) filter (truth = prediction) correct, count(*) total,
       round(avg(case when truth = prediction then 1.0 else 0.0 end), 6) accuracy from predictions""",
    ("predictions",),
)
def accuracy_query(spark, sf_dir):
    return accuracy(classify_clustered(*train_test(spark, sf_dir))).withColumn("accuracy", r6("accuracy"))


@query(
    "accuracy_macro",
    """select round(sum(hits) / sum(support), 6) accuracy, round(avg(case when predicted > 0 then hits / predicted else 0 end), 6) "precision",
       round(avg(case when support > 0 then hits / support else 0 end), 6) recall,
       round(avg(2 * hits / (support + predicted)), 6) f1
       from (select label, count(*) filter (truth = label and prediction = label) hits,
         count(*) filter (truth = label) support, count(*) filter (prediction = label) predicted
         from predictions, (select truth label from predictions union select prediction from predictions) l
         where label is not null group by label)""",
    ("predictions",),
)
def accuracy_macro(spark, sf_dir):
    scores = evaluate(classify_clustered(*train_test(spark, sf_dir)))
    return scores.select(*[r6(c).alias(c) for c in scores.columns])


@query(
    "vector_index_search",
    f"""select * from (select q.vec_id query_id, row_number() over (partition by q.vec_id order by {sq_sql('q.v', 'b.v')}, b.vec_id) rank,
          b.vec_id neighbor_id, round({sq_sql('q.v', 'b.v')}, 6) sq_dist, b.subcategory
        from test q cross join train b) where rank <= 5""",
    ("train", "test"),
)
def vector_index_search(spark, sf_dir):
    """Search in a stored index that was written in two versions."""
    train, test = train_test(spark, sf_dir)
    path = scratch(spark)
    index = build_vector_index(train.where("vec_id % 3 > 0"), path, carry=["subcategory"], buckets=8)
    append_to_index(index, train.where("vec_id % 3 = 0"))
    found = search_index(open_vector_index(spark, path), test, k=5)
    return found.withColumn("sq_dist", r6("sq_dist"))


# --- representatives and prototypes --------------------------------------------------

_MEAN = "select {k}, pos, round(avg(x), 6) x from (select {k}, unnest(v::double[]) x, cast(generate_subscripts(v, 1) - 1 as int) pos from {t}) group by all"


@query("group_mean", _MEAN.format(k="cluster", t="emb_clustered"), _CLUSTERED)
def group_mean_query(spark, sf_dir):
    return _long(group_mean(emb_clustered(spark, sf_dir), "cluster"), "representative", "cluster")


@query("prototype_means", _MEAN.format(k="cluster, subcategory", t="train"), _TRAIN)
def prototype_means(spark, sf_dir):
    found = cluster_prototypes(train_test(spark, sf_dir)[0], "mean")
    return _long(found, "proto", "cluster", "subcategory")


def _totals_sql(by, source):
    on = " and ".join(f"a.{c} = b.{c}" for c in by)
    keys = ", ".join(f"a.{c}" for c in by)
    return (
        f"select {keys}, a.vec_id, any_value(a.v) v, sum({l2_sql('a.v', 'b.v')}) total, count(*) n "
        f"from {source} a join {source} b on {on} group by {keys}, a.vec_id"
    )


def _medoid_sql(by, source):
    keys = ", ".join(by)
    return (
        f"select * from (select *, row_number() over (partition by {keys} order by round(total, 9), vec_id) rk "
        f"from ({_totals_sql(by, source)})) where rk = 1"
    )


@query(
    "group_distance_totals",
    f"select cluster, vec_id, round(total, 6) total from ({_totals_sql(['cluster'], 'emb_clustered')})",
    _CLUSTERED,
)
def group_distance_totals(spark, sf_dir):
    totals = total_distances(emb_clustered(spark, sf_dir), "cluster")
    return totals.select("cluster", "vec_id", r6("total").alias("total"))


_MEDOID = f"select cluster, vec_id, n, round(total, 6) total from ({_medoid_sql(['cluster'], 'emb_clustered')})"


@query("group_medoid", _MEDOID, _CLUSTERED)
def group_medoid_query(spark, sf_dir):
    found = group_medoid(emb_clustered(spark, sf_dir), "cluster")
    return found.select("cluster", "vec_id", "n", r6("total").alias("total"))


@query("group_medoid_blocks", _MEDOID, _CLUSTERED)
def group_medoid_blocks(spark, sf_dir):
    """The same with groups cut into small blocks, as for hot clusters."""
    found = group_medoid(emb_clustered(spark, sf_dir), "cluster", block_rows=20)
    return found.select("cluster", "vec_id", "n", r6("total").alias("total"))


@query(
    "cluster_prototypes",
    _long_sql("cluster, subcategory", "v", f"({_medoid_sql(['cluster', 'subcategory'], 'train')})"),
    _TRAIN,
)
def cluster_prototypes_query(spark, sf_dir):
    found = cluster_prototypes(train_test(spark, sf_dir)[0])
    return _long(found, "proto", "cluster", "subcategory")


@query("cluster_centroids", _long_sql("cluster", "v", f"({_medoid_sql(['cluster'], 'train')})"), _TRAIN)
def cluster_centroids_query(spark, sf_dir):
    return _long(cluster_centroids(train_test(spark, sf_dir)[0]), "centroid", "cluster")


@query(
    "prototype_search",
    f"""select * from (select t.cluster, t.vec_id query_id, row_number() over (partition by t.vec_id
          order by {sq_sql('t.v', 'p.v')}, p.subcategory) rank, p.subcategory,
          round({sq_sql('t.v', 'p.v')}, 6) sq_dist
        from test t join ({_medoid_sql(['cluster', 'subcategory'], 'train')}) p on t.cluster = p.cluster)
        where rank <= 3""",
    ("train", "test"),
)
def prototype_search(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    path = scratch(spark)
    build_prototype_index(cluster_prototypes(train), cluster_centroids(train), path)
    prototypes, _ = read_prototype_index(spark, path)
    return search_prototypes(test, prototypes, k=3).withColumn("sq_dist", r6("sq_dist"))


@query(
    "routed_prototype_search",
    f"""select * from (select r.cluster, r.vec_id query_id, row_number() over (partition by r.vec_id
          order by {sq_sql('r.v', 'p.v')}, p.subcategory) rank, p.subcategory, round({sq_sql('r.v', 'p.v')}, 6) sq_dist
        from (select vec_id, v, cluster from (select t.vec_id, t.v, c.cluster, row_number() over (partition by t.vec_id
            order by {sq_sql('t.v', 'c.v')}, c.cluster) n from test t cross join ({_medoid_sql(['cluster'], 'train')}) c) where n = 1) r
        join ({_medoid_sql(['cluster', 'subcategory'], 'train')}) p on r.cluster = p.cluster)
        where rank <= 3""",
    ("train", "test"),
)
def routed_prototype_search(spark, sf_dir):
    """Queries find their cluster by the stored centroids."""
    train, test = train_test(spark, sf_dir)
    path = scratch(spark)
    build_prototype_index(cluster_prototypes(train), cluster_centroids(train), path)
    return routed_search(test, *read_prototype_index(spark, path), k=3).withColumn("sq_dist", r6("sq_dist"))


_PROTOS = f"""(select subcategory label, list(m order by pos) proto from (
      select subcategory, pos, avg(x) m from (select subcategory, unnest(u) x, generate_subscripts(u, 1) pos
        from (select subcategory, {unit_sql('v')} u from emb where split = 'train')) group by all) group by 1)"""
_SCORES = f"""(select q.vec_id, p.label, -{l2_sql('q.u', 'p.proto')} score
      from (select vec_id, {unit_sql('v')} u from emb where split = 'test') q cross join {_PROTOS} p)"""


@query("prototypical_scores", f"select vec_id, label, round(score, 6) score from {_SCORES}", _EMB)
def prototypical_scores(spark, sf_dir):
    rows = emb(spark, sf_dir)
    protos = label_prototypes(rows.where("split = 'train'"))
    return prototype_scores(rows.where("split = 'test'"), protos).withColumn("score", r6("score"))


@query("prototypical_scores_by_join", f"select vec_id, label, round(score, 6) score from {_SCORES}", _EMB)
def prototypical_scores_by_join(spark, sf_dir):
    """The way beyond the broadcast bound."""
    rows = emb(spark, sf_dir)
    protos = label_prototypes(rows.where("split = 'train'"))
    return prototype_scores(rows.where("split = 'test'"), protos, max_prototypes=1).withColumn("score", r6("score"))


@query(
    "prototypical_classify",
    f"""select vec_id query_id, label prediction, round(score, 6) score from (select *, row_number() over
        (partition by vec_id order by score desc, label) rk from {_SCORES}) where rk = 1""",
    _EMB,
)
def prototypical_classify_query(spark, sf_dir):
    rows = emb(spark, sf_dir)
    found = prototypical_classify(rows.where("split = 'train'"), rows.where("split = 'test'"))
    return found.withColumn("score", r6("score"))


# --- neighbour graph -----------------------------------------------------------------


_GRAPH = f"""select * from (select a.vec_id src, b.vec_id dst, row_number() over (partition by a.vec_id
          order by {sq_sql('a.v', 'b.v')}, b.vec_id) rank, round({l2_sql('a.v', 'b.v')}, 6) dist
        from emb a join emb b on a.vec_id <> b.vec_id) where rank <= 27"""


@query("knn_graph", _GRAPH, _EMB)
def knn_graph_query(spark, sf_dir):
    return knn_graph(emb(spark, sf_dir)).withColumn("dist", r6("dist"))


@query("knn_graph_pruned", _GRAPH, _EMB)
def knn_graph_pruned(spark, sf_dir):
    """Pruned whatever the saving."""
    rows = emb(spark, sf_dir)
    near = knn_join_pruned(rows, rows, 27, exclude_self=True, cells=32, worth_share=1.0)
    return near.select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "rank",
                       r6(F.sqrt("sq_dist")).alias("dist"))


@query("knn_graph_descent")
def knn_graph_descent(spark, sf_dir):
    """The same graph by neighbour descent: a bounded number of distances per row, most neighbours found."""
    return knn_graph(emb(spark, sf_dir), method="descent").withColumn("dist", r6("dist"))
