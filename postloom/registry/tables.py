"""Sources, projections, joins, profiles, samples and label queries."""

from pyspark.sql import functions as F

from postloom.operators.evaluate import group_sizes
from postloom.operators.labels import label_decode, label_encode, label_vocabulary
from postloom.operators.profile import frequency_shape, n_unique, profile_nulls, value_counts
from postloom.operators.relational import (
    attach, drop_noise, enrich, preview, select_mapped, top_n, union_splits, with_support,
)
from postloom.operators.sampling import hash_split, random_split, sample_n
from postloom.plans.prepare import keep_clean, labelled_posts, prepare_posts
from postloom.registry.base import (
    emb, emb_clustered, lookup, posts, query, r6, scratch, table, u_sql,
)
from postloom.registry.texts import _clean, _normalize
from postloom.sources.tables import (
    read_embeddings, read_lookup, read_posts, read_splits, vectors_or_compute, write_splits,
)

_EMB, _CLUSTERED, _LABELLED = ("emb",), ("emb_clustered",), ("labelled",)


def _write_delimited(df, path, sep):
    (df.write.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# --- sources and sinks ---------------------------------------------------------------


@query("read_posts", "select * from posts", ("posts",))
def read_posts_query(spark, sf_dir):
    path = scratch(spark)
    _write_delimited(posts(spark, sf_dir), path, "\t")
    return read_posts(spark, path, multiline=True)


@query("read_lookup", "select * from lookup", ("lookup",))
def read_lookup_query(spark, sf_dir):
    path = scratch(spark)
    _write_delimited(lookup(spark, sf_dir), path, ",")
    return read_lookup(spark, path)


@query("read_splits", "select vec_id, subcategory, split from emb where split in ('train', 'test')", _EMB)
def read_splits_query(spark, sf_dir):
    path = scratch(spark)
    write_splits(emb(spark, sf_dir), path)
    return read_splits(spark, path, ["train", "test"]).select("vec_id", "subcategory", "split")


@query("read_embeddings", "select vec_id, len(embedding) dim, round(list_sum(embedding::double[]), 6) total from embeddings")
def read_embeddings_query(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read_embeddings(spark, f"{sf_dir}/embeddings.parquet", dim=64).select(
        "vec_id", F.size("embedding").cast("long").alias("dim"), r6(total).alias("total")
    )


@query("cached_vectors", "select vec_id, cluster, subcategory from emb_clustered", _CLUSTERED)
def cached_vectors(spark, sf_dir):
    path = scratch(spark)
    vectors_or_compute(spark, path, lambda: emb_clustered(spark, sf_dir))
    return vectors_or_compute(spark, path, lambda: None).select("vec_id", "cluster", "subcategory")


# --- projections and filters ---------------------------------------------------------


@query("select_mapped", "select * from labelled", _LABELLED)
def select_mapped_query(spark, sf_dir):
    return select_mapped(enrich(posts(spark, sf_dir), lookup(spark, sf_dir)))


@query(
    "keep_clean",
    f"select id, subreddit, title, text raw_text, category, subcategory, {_normalize(_clean('text'))} as text from labelled",
    _LABELLED,
)
def keep_clean_query(spark, sf_dir):
    from postloom.plans.prepare import preprocess

    rows = preprocess(labelled_posts(posts(spark, sf_dir), lookup(spark, sf_dir)))
    return keep_clean(rows.withColumn("impurity", F.lit(0.0)))


@query("attach_clusters", "select vec_id, split, cluster from emb_clustered", _CLUSTERED)
def attach_clusters(spark, sf_dir):
    clusters = emb_clustered(spark, sf_dir).select("vec_id", "cluster")
    return attach(emb(spark, sf_dir).select("vec_id", "split"), clusters, "vec_id")


_NOISY = "case when category = 3 then -1 else cluster end"


@query("drop_noise", f"select vec_id, {_NOISY} cluster from emb_clustered where {_NOISY} <> -1", _CLUSTERED)
def drop_noise_query(spark, sf_dir):
    noisy = emb_clustered(spark, sf_dir).select("vec_id", F.expr(_NOISY).alias("cluster"))
    return drop_noise(noisy)


@query(
    "minimum_support",
    "select cluster, subcategory, count(*) n from emb_clustered group by all having count(*) >= 4",
    _CLUSTERED,
)
def minimum_support(spark, sf_dir):
    return with_support(emb_clustered(spark, sf_dir), ["cluster", "subcategory"], 4)


@query("one_group", "select vec_id from emb_clustered where cluster = 3 and subcategory = 5", _CLUSTERED)
def one_group(spark, sf_dir):
    return emb_clustered(spark, sf_dir).where("cluster = 3 and subcategory = 5").select("vec_id")


# --- joins and unions ----------------------------------------------------------------


@query(
    "enrich_left_join",
    "select p.id, p.subreddit, l.category_1, l.category_2 from posts p left join lookup l on p.subreddit = l.subreddit",
    ("posts", "lookup"),
)
def enrich_left_join(spark, sf_dir):
    joined = enrich(posts(spark, sf_dir), lookup(spark, sf_dir))
    return joined.select("id", "subreddit", "category_1", "category_2")


@query(
    "union_splits",
    """select split, count(*) n from (select * from emb where split = 'train' union all
       select * from emb where split = 'validation' union all select * from emb where split = 'test') group by 1""",
    _EMB,
)
def union_splits_query(spark, sf_dir):
    rows = emb(spark, sf_dir)
    parts = [rows.where(F.col("split") == s) for s in ("train", "validation", "test")]
    return group_sizes(union_splits(*parts), "split").withColumnRenamed("counts", "n")


# --- profiles ------------------------------------------------------------------------


@query(
    "profile_nulls",
    " union all ".join(
        f"""select '{c}' "column", 'string' dtype, count(*) filter ({c} is null) nulls, count(*) "rows" from labelled"""
        for c in ("id", "subreddit", "title", "text", "category", "subcategory")
    ),
    _LABELLED,
)
def profile_nulls_query(spark, sf_dir):
    return profile_nulls(labelled_posts(posts(spark, sf_dir), lookup(spark, sf_dir)))


@query("n_unique", "select count(distinct subcategory) n_unique from labelled", _LABELLED)
def n_unique_query(spark, sf_dir):
    return n_unique(labelled_posts(posts(spark, sf_dir), lookup(spark, sf_dir)), "subcategory")


@query(
    "value_counts",
    "select category, count(*) \"count\" from labelled where category is not null group by 1",
    _LABELLED,
)
def value_counts_query(spark, sf_dir):
    return value_counts(labelled_posts(posts(spark, sf_dir), lookup(spark, sf_dir)), "category")


@query(
    "frequency_shape",
    """select round(skewness(n), 6) skewness, round(kurtosis(n), 6) kurtosis from
       (select count(*) n from labelled where category is not null group by category)""",
    _LABELLED,
)
def frequency_shape_query(spark, sf_dir):
    shape = frequency_shape(labelled_posts(posts(spark, sf_dir), lookup(spark, sf_dir)), "category")
    return shape.select(r6("skewness").alias("skewness"), r6("kurtosis").alias("kurtosis"))


# --- sorts, samples and splits -------------------------------------------------------


@query("sort_by_cluster", "select cluster, vec_id from emb_clustered order by cluster, vec_id", _CLUSTERED)
def sort_by_cluster(spark, sf_dir):
    return emb_clustered(spark, sf_dir).select("cluster", "vec_id").orderBy("cluster", "vec_id")


@query("preview", "select doc_id, lang, source from documents order by doc_id limit 5")
def preview_query(spark, sf_dir):
    return preview(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("longest_posts", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 10")
def longest_posts(spark, sf_dir):
    return top_n(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("split_counts", "select split, count(*) counts from emb group by 1", _EMB)
def split_counts(spark, sf_dir):
    return group_sizes(emb(spark, sf_dir), "split")


@query(
    "hash_split",
    f"""select doc_id, case when u < 0.8 then 'train' when u < 0.9 then 'test' else 'validation' end split
        from (select doc_id, {u_sql('doc_id')} u from documents)""",
)
def hash_split_query(spark, sf_dir):
    return hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "random_split",
    """select doc_id, case when r <= n - ceil(n * 0.2) then 'train'
         when r <= n - ceil(ceil(n * 0.2) * 0.5) then 'test' else 'validation' end split
       from (select doc_id, row_number() over (order by md5('42:'||doc_id), doc_id) r,
             count(*) over () n from documents)""",
)
def random_split_query(spark, sf_dir):
    return random_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "sample_train",
    """select vec_id from (select vec_id, row_number() over (order by md5('42:'||vec_id), vec_id) r,
       count(*) over () n from emb where split = 'train') where r <= floor(n * 0.25)""",
    _EMB,
)
def sample_train(spark, sf_dir):
    return sample_n(emb(spark, sf_dir).where("split = 'train'"), "vec_id", ratio=0.25).select("vec_id")


@query(
    "small_splits",
    """select vec_id, split from (select vec_id, split, row_number() over (partition by split
       order by md5('42:'||vec_id), vec_id) r, count(*) over (partition by split) n from emb) where r <= n // 10""",
    _EMB,
)
def small_splits(spark, sf_dir):
    rows = emb(spark, sf_dir).select("vec_id", "split")
    parts = [sample_n(rows.where(F.col("split") == s), "vec_id", ratio=0.1) for s in ("train", "validation", "test")]
    return union_splits(*parts)


# --- labels --------------------------------------------------------------------------

_VOCAB = """(select category label, cast(row_number() over (order by category) - 1 as int) idx
             from (select distinct category from labelled where category is not null))"""


@query("label_encode", f"select l.id, v.idx category from labelled l left join {_VOCAB} v on l.category = v.label", _LABELLED)
def label_encode_query(spark, sf_dir):
    rows = labelled_posts(posts(spark, sf_dir), lookup(spark, sf_dir)).select("id", "category")
    return label_encode(rows, "category", label_vocabulary(rows, "category")).select("id", "category")


@query("label_decode", "select id, category label from labelled", _LABELLED)
def label_decode_query(spark, sf_dir):
    rows = labelled_posts(posts(spark, sf_dir), lookup(spark, sf_dir)).select("id", "category")
    vocabulary = label_vocabulary(rows, "category")
    return label_decode(label_encode(rows, "category", vocabulary), "category", vocabulary).select("id", "label")


@query("distinct_labels", "select distinct cluster, category, subcategory from emb_clustered", _CLUSTERED)
def distinct_labels(spark, sf_dir):
    return emb_clustered(spark, sf_dir).select("cluster", "category", "subcategory").distinct()


# --- the whole preparation job -------------------------------------------------------


@query(
    "prepare_posts",
    f"""select id, subreddit, category, subcategory, {_normalize(_clean('text'))} clean_text,
        case when r <= n - ceil(n * 0.2) then 'train' when r <= n - ceil(ceil(n * 0.2) * 0.5) then 'test'
        else 'validation' end split
        from (select *, row_number() over (order by md5('42:'||id), id) r, count(*) over () n from labelled)""",
    _LABELLED,
)
def prepare_posts_query(spark, sf_dir):
    root = scratch(spark)
    _write_delimited(posts(spark, sf_dir), f"{root}/posts", "\t")
    _write_delimited(lookup(spark, sf_dir), f"{root}/lookup", ",")
    out = prepare_posts(spark, f"{root}/posts", f"{root}/lookup", f"{root}/splits")
    return out.select("id", "subreddit", "category", "subcategory", "clean_text", "split")
