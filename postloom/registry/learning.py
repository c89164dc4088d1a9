"""Token, embedding, clustering and classifier queries."""

import numpy as np
from pyspark.sql import functions as F

from postloom.operators.cluster import fit_clusters, get_centroids, predict_clusters, reduce
from postloom.operators.embed import embed_text, embed_tokens, learn_vocabulary, token_windows, tokenize
from postloom.operators.evaluate import evaluate
from postloom.operators.lineage import cut_lineage
from postloom.operators.reduce import fuzzy_graph, graph_embed, knn_graph
from postloom.plans.classify import classify_zero_shot, predict_categories, train_category_classifier
from postloom.plans.prepare import labelled_posts, prepare_embeddings
from postloom.operators.sampling import hash_split
from postloom.registry.base import emb, lookup, posts, query, r6, scratch, sq_sql, table, texts
from postloom.sources.tables import load_model, save_model, write_splits

_TOKENS = r"""(select doc_id, token, pos from (select doc_id, unnest(t) token, generate_subscripts(t, 1) pos
    from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') t from documents)))"""
_VOCABULARY = f"""(select token, row_number() over (order by md5(token), token) + 3 token_id
    from (select distinct token from {_TOKENS}))"""


@query("learn_vocabulary", f"select token, cast(token_id as int) token_id from {_VOCABULARY}")
def learn_vocabulary_query(spark, sf_dir):
    return learn_vocabulary(texts(spark, sf_dir))


_TOKENIZE = f"""select d.doc_id, coalesce('2 ' || ids || ' 3', '2 3') ids, coalesce(n, 0) + 2 n from documents d
    left join (select doc_id, string_agg(token_id, ' ' order by pos) ids, count(*) n
    from {_TOKENS} join {_VOCABULARY} using (token) group by 1) t on d.doc_id = t.doc_id"""


def _tokenize(spark, sf_dir, **options):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    out = tokenize(docs, learn_vocabulary(docs), key="doc_id", max_length=None, **options)
    return out.select(
        "doc_id",
        F.array_join(F.transform("input_ids", lambda i: i.cast("string")), " ").alias("ids"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"),
    )


@query("tokenize", _TOKENIZE)
def tokenize_query(spark, sf_dir):
    return _tokenize(spark, sf_dir)


@query("tokenize_by_join", _TOKENIZE)
def tokenize_by_join(spark, sf_dir):
    """The way for a vocabulary beyond the broadcast bound."""
    return _tokenize(spark, sf_dir, max_vocabulary=1)


@query("tokenize_head_and_tail", _TOKENIZE)
def tokenize_head_and_tail(spark, sf_dir):
    """The same with tokens of more than 20 places looked up before the rest is joined."""
    return _tokenize(spark, sf_dir, max_vocabulary=1, hot_rows=20)


@query(
    "hashed_embedding",
    f"""select doc_id, cast(dim as int) dim, round(s / sqrt(sum(s * s) over (partition by doc_id)), 6) x from (
        select doc_id, cast('0x'||substr(md5(token),1,8) as bigint) % 64 dim,
          sum(case when substr(md5(token),9,1) < '8' then 1.0 else -1.0 end)::double s from {_TOKENS} group by all)
        where s <> 0""",
)
def hashed_embedding(spark, sf_dir):
    rows = embed_text(texts(spark, sf_dir).select("doc_id", "text"))
    long = rows.select("doc_id", F.posexplode_outer("embedding").alias("dim", "x")).where("x <> 0")
    return long.select("doc_id", "dim", r6("x").alias("x"))


_WINDOW = 100


@query(
    "token_windows",
    f"""select d.doc_id, coalesce(w.window, 0) as "window", coalesce('2 ' || ids || ' 3', '2 3') ids from documents d
    left join (select doc_id, cast(floor((pos - 1) / {_WINDOW - 2}) as int) as "window", string_agg(token_id, ' ' order by pos) ids
    from {_TOKENS} join {_VOCABULARY} using (token) group by 1, 2) w on d.doc_id = w.doc_id""",
)
def token_windows_query(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    out = token_windows(tokenize(docs, learn_vocabulary(docs), key="doc_id"), size=_WINDOW)
    return out.select("doc_id", "window", F.array_join(F.transform("input_ids", lambda i: i.cast("string")), " ").alias("ids"))


def _mean_of_ids():
    """A model for the check: of a row's ids the mean, the greatest and their number."""
    def predict(ids, mask):
        n = mask.sum(1)
        return np.stack([(ids * mask).sum(1) / n, (ids * mask).max(1), n], 1)
    return predict


@query(
    "embed_tokens",
    f"""select d.doc_id, round((coalesce(s, 0) + 5) / (coalesce(n, 0) + 2), 6) mean_id, greatest(coalesce(m, 0), 3)::double max_id,
      (coalesce(n, 0) + 2)::double n from documents d left join (
        select doc_id, sum(token_id) s, max(token_id) m, count(*) n from {_TOKENS} join {_VOCABULARY} using (token) group by 1) t
      on d.doc_id = t.doc_id""",
)
def embed_tokens_query(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", "text")
    out = embed_tokens(tokenize(docs, learn_vocabulary(docs), key="doc_id"), _mean_of_ids)
    return out.select("doc_id", r6(F.col("embedding")[0]).alias("mean_id"), F.col("embedding")[1].alias("max_id"), F.col("embedding")[2].alias("n"))


_PREPARED = r"""with l as (select *, u < 0.8 is_train, case when u < 0.8 then 'train' when u < 0.9 then 'test' else 'validation' end split
    from (select *, cast(cast('0x'||substr(md5('42:'||id),1,8) as bigint) as double)/4294967296 u from (
      select cast(doc_id as varchar) id, split_part(text, chr(10), 1) || ' [SEP] ' || text as combined,
        'cat' || (cast(substr(source, 4) as int) % 5) cat, source from documents) p)),
  k as (select id, split, is_train, combined, case when source in ('src18', 'src19') then null else cat end category,
    case when source in ('src18', 'src19') then null else source end subcategory from l),
  t as (select id, is_train, token, pos from (select id, is_train, unnest(x) token, generate_subscripts(x, 1) pos
    from (select id, is_train, regexp_extract_all(lower(combined), '[\p{L}\p{N}]+') x from k))),
  v as (select token, row_number() over (order by md5(token), token) + 3 token_id from (select distinct token from t where is_train)),
  c as (select category, row_number() over (order by category) - 1 i from (select distinct category from k where is_train and category is not null)),
  s as (select subcategory, row_number() over (order by subcategory) - 1 i from (select distinct subcategory from k where is_train and subcategory is not null))
  select k.id, k.split, cast(c.i as int) category, cast(s.i as int) subcategory, '2 ' || ids || ' 3' ids, 64 dim from k
    left join c using (category) left join s using (subcategory)
    join (select id, string_agg(coalesce(token_id, 1), ' ' order by pos) ids from t left join v using (token) group by 1) x on k.id = x.id"""


@query("prepare_embeddings", _PREPARED)
def prepare_embeddings_query(spark, sf_dir):
    root = scratch(spark)
    rows = hash_split(labelled_posts(posts(spark, sf_dir), lookup(spark, sf_dir)), "id")
    write_splits(rows, f"{root}/in")
    out = prepare_embeddings(spark, f"{root}/in", f"{root}/out")
    ids = F.array_join(F.transform("input_ids", lambda i: i.cast("string")), " ")
    return out.select("id", "split", "category", "subcategory", ids.alias("ids"), F.size("embedding").alias("dim"))


def _fitted(spark, sf_dir):
    rows = emb(spark, sf_dir)
    return rows, fit_clusters(rows.where("split = 'train'"), partitions=8)


# SQL cannot fit the models of the next five queries.  tests/test_learning.py holds their rows against plain
# joins over the stored model and recomputes the metrics in SQL.


@query("fit_clusters")
def fit_clusters_query(spark, sf_dir):
    """The cluster of every training row."""
    rows, model = _fitted(spark, sf_dir)
    return predict_clusters(rows.where("split = 'train'"), model).select("vec_id", "cluster")


@query("predict_clusters")
def predict_clusters_query(spark, sf_dir):
    """The cluster of every test row, by a model that was saved and loaded."""
    rows, model = _fitted(spark, sf_dir)
    path = scratch(spark)
    save_model(spark, model, path)
    return predict_clusters(rows.where("split = 'test'"), load_model(spark, path)).select("vec_id", "cluster")


@query("predict_clusters_graph")
def predict_clusters_graph(spark, sf_dir):
    """The cluster of every row by the graph reducer, fitted on the training rows, saved and loaded."""
    rows = emb(spark, sf_dir)
    path = scratch(spark)
    save_model(spark, fit_clusters(rows.where("split = 'train'"), partitions=8, method="graph"), path)
    return predict_clusters(rows, load_model(spark, path)).select("vec_id", "split", "cluster")


@query("get_centroids")
def get_centroids_query(spark, sf_dir):
    """All components of the centroids, in the reduced space."""
    _, model = _fitted(spark, sf_dir)
    return get_centroids(model, spark).select("cluster", F.posexplode("centroid").alias("pos", "x")).withColumn("x", r6("x"))


def _with_metrics(predictions, metrics, *columns):
    """Predictions with the metrics of all of them, a single row."""
    return predictions.select(*columns, "truth", "prediction").crossJoin(F.broadcast(metrics.select(*[r6(c).alias(c) for c in metrics.columns])))


@query("classify_zero_shot")
def classify_zero_shot_query(spark, sf_dir):
    """Every test row's cluster, label and prediction, and the metrics."""
    rows = emb(spark, sf_dir)
    predictions, metrics, _ = classify_zero_shot(rows.where("split = 'train'"), rows.where("split = 'test'"), partitions=8)
    return _with_metrics(cut_lineage(predictions), metrics, "vec_id", "cluster")


@query("category_classifier")
def category_classifier(spark, sf_dir):
    """Predictions for all labelled documents that were not learned from, and the metrics."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = texts(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id")
    path = scratch(spark)
    hash_split(embed_text(docs), "doc_id").drop("text").write.parquet(path)
    rows = spark.read.parquet(path)
    model = train_category_classifier(rows.where("split = 'train'"), "quality")
    found = predict_categories(rows.where("split <> 'train'"), model, "quality").select("doc_id", "truth", "prediction")
    return _with_metrics(found, evaluate(found), "doc_id")


# The bandwidth by 80 bisections per row, from the definition; edges whose strengths vanish stay.
_FUZZY = f"""select src, dst, round(max(a) + max(b) - max(a) * max(b), 6) weight from (
  with recursive g as (
    select src, dst, dist from (select q.vec_id src, b.vec_id dst, sqrt({sq_sql('q.v', 'b.v')}) dist,
      row_number() over (partition by q.vec_id order by {sq_sql('q.v', 'b.v')}, b.vec_id) rank
      from emb q join emb b on q.vec_id <> b.vec_id) where rank <= 27),
  r as (select src, list(greatest(dist - coalesce(rho, 0), 0)) gaps, avg(dist) mean, any_value(coalesce(rho, 0)) rho, count(*) k
    from g left join (select src, min(dist) rho from g where dist > 0 group by 1) using (src) group by 1),
  s(src, low, high, n) as (
    select src, 0.0::double, 1e6::double, 0 from r
    union all
    select s.src, case when over then low else (low + high) / 2 end, case when over then (low + high) / 2 else high end, n + 1
    from (select s.*, list_sum(list_transform(gaps, lambda x: exp(-x / ((low + high) / 2)))) > log2(k) as over from s join r using (src) where n < 80) s),
  w as (select g.src, g.dst, exp(-greatest(dist - rho, 0) / greatest((low + high) / 2, 1e-3 * mean, 1e-12)) weight
    from g join r using (src) join s using (src) where n = 80)
  select src, dst, weight a, 0 b from w union all select dst, src, 0, weight from w) group by 1, 2"""


@query("fuzzy_graph", _FUZZY, ("emb",))
def fuzzy_graph_query(spark, sf_dir):
    return fuzzy_graph(knn_graph(emb(spark, sf_dir))).select("src", "dst", r6("weight").alias("weight"))


_ROUNDS = 3


def _moved_sql(n):
    """Coordinates after round n: half of the way to the weighted mean of the neighbours."""
    return f"""p{n} as materialized (
      select vec_id, pos, case when mean is null then x else 0.5::double * x + 0.5::double * mean end x from p{n - 1} left join (
        select dst vec_id, pos, sum(weight * x) / sum(weight) mean from e join p{n - 1} on src = vec_id group by all) using (vec_id, pos))"""


_WEIGHTS = _FUZZY.replace("round(max(a) + max(b) - max(a) * max(b), 6)", "max(a) + max(b) - max(a) * max(b)")
_EMBEDDED = f"""select vec_id, cast(pos as int) pos, round(x, 6) x from (
  with e as materialized ({_WEIGHTS}),
  p0 as materialized (select vec_id, unnest(v::double[]) x, generate_subscripts(v, 1) - 1 pos from emb),
  {", ".join(_moved_sql(n) for n in range(1, _ROUNDS + 1))}
  select * from p{_ROUNDS})"""


@query("graph_embed", _EMBEDDED, ("emb",))
def graph_embed_query(spark, sf_dir):
    """Vectors moved towards their neighbours in the fuzzy graph, in a few rounds."""
    rows = emb(spark, sf_dir)
    moved = graph_embed(rows, fuzzy_graph(knn_graph(rows)), iterations=_ROUNDS, name="v")
    return moved.select("vec_id", F.posexplode_outer("v").alias("pos", "x")).withColumn("x", r6("x"))


@query("reduced_graph_embed")
def reduced_graph_embed(spark, sf_dir):
    """The same from coordinates of the fitted reducer."""
    rows, model = _fitted(spark, sf_dir)
    moved = graph_embed(reduce(rows, model.reducer), fuzzy_graph(knn_graph(rows)))
    return moved.select("vec_id", F.posexplode_outer("reduced").alias("pos", "x"))
