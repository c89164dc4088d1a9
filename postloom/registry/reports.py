"""Cluster reports, majority categories, class weights and episodes."""

from pyspark.sql import functions as F

from postloom.operators.evaluate import (
    cluster_label_sets, cluster_quality, cluster_recall_density, group_sizes, share_of_group,
)
from postloom.operators.fewshot import (
    associated_subcategories, class_weights, cluster_ranges, few_shot_episodes, major_categories,
    majority_info,
)
from postloom.registry.base import emb_clustered, query, r6, train_test

_CLUSTERED, _BOTH = ("emb_clustered",), ("train", "test", "label_counts")


def _joined(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


@query(
    "cluster_label_sets",
    "select cluster, string_agg(subcategory, ',' order by subcategory) subcategories from label_counts group by 1",
    _BOTH,
)
def cluster_label_sets_query(spark, sf_dir):
    sets = cluster_label_sets(train_test(spark, sf_dir)[0])
    return sets.select("cluster", _joined("subcategories").alias("subcategories"))


@query("group_sizes", "select cluster, subcategory, counts from label_counts", _BOTH)
def group_sizes_query(spark, sf_dir):
    return group_sizes(train_test(spark, sf_dir)[0], "cluster", "subcategory")


@query(
    "share_of_group",
    "select cluster, subcategory, counts, round(counts / sum(counts) over (partition by cluster), 6) share from label_counts",
    _BOTH,
)
def share_of_group_query(spark, sf_dir):
    counts = group_sizes(train_test(spark, sf_dir)[0], "cluster", "subcategory")
    return share_of_group(counts, ["cluster"]).withColumn("share", r6("share"))


_SIZES = """(select cluster, cast(sum(counts) as bigint) cluster_size, max(counts) top,
    string_agg(subcategory, ',' order by subcategory) subcategories from label_counts group by 1)"""


@query(
    "cluster_recall_density",
    f"""select t.vec_id, t.category, t.cluster, t.subcategory, s.subcategories, c.counts is not null hit,
        coalesce(c.counts, 0) counts, s.cluster_size, round(coalesce(c.counts, 0) / s.cluster_size, 6) proportion
        from test t join {_SIZES} s on t.cluster = s.cluster
        left join label_counts c on t.cluster = c.cluster and t.subcategory = c.subcategory""",
    _BOTH,
)
def cluster_recall_density_query(spark, sf_dir):
    out = cluster_recall_density(*train_test(spark, sf_dir), key="vec_id")
    return out.withColumn("subcategories", _joined("subcategories")).withColumn("proportion", r6("proportion"))


@query(
    "cluster_quality",
    f"""select coalesce(s.cluster, r.cluster) cluster, round(r.recall, 6) recall, round(s.top / s.cluster_size, 6) density
        from {_SIZES} s full join (select t.cluster, avg(case when c.counts is null then 0.0 else 1.0 end) recall
          from test t left join label_counts c on t.cluster = c.cluster and t.subcategory = c.subcategory group by 1) r
        on s.cluster = r.cluster""",
    _BOTH,
)
def cluster_quality_query(spark, sf_dir):
    out = cluster_quality(*train_test(spark, sf_dir))
    return out.select("cluster", r6("recall").alias("recall"), r6("density").alias("density"))


def _major_sql(threshold):
    return f"""(select cluster, category, counts, share from (select cluster, category, count(*) counts,
        count(*) / sum(count(*)) over (partition by cluster) share,
        row_number() over (partition by cluster order by count(*) desc, category) place
        from emb_clustered group by cluster, category) where share >= {threshold} or place = 1)"""


def _register_major(name, threshold):
    @query(name, f"select cluster, category, counts, round(share, 6) share from {_major_sql(threshold)}", _CLUSTERED)
    def run(spark, sf_dir):
        return major_categories(emb_clustered(spark, sf_dir), threshold).withColumn("share", r6("share"))


for _name, _threshold in (
    ("major_categories", 0.05), ("major_categories_filtered", 0.3), ("major_categories_fallback", 0.9),
):
    _register_major(_name, _threshold)

_SUPPORTED = "(select cluster, subcategory, count(*) counts from emb_clustered group by all having count(*) >= {})"


def _linked_sql(minimum, threshold):
    return f"""(select distinct e.cluster, e.category, e.subcategory from emb_clustered e
        join {_major_sql(threshold)} m on e.cluster = m.cluster and e.category = m.category
        join {_SUPPORTED.format(minimum)} s on e.cluster = s.cluster and e.subcategory = s.subcategory)"""


@query("associated_subcategories", f"select * from {_linked_sql(4, 0.3)}", _CLUSTERED)
def associated_subcategories_query(spark, sf_dir):
    return associated_subcategories(emb_clustered(spark, sf_dir), 4, 0.3)


@query(
    "majority_info",
    f"""select m.cluster, string_agg(distinct m.category, ',' order by m.category) major_categories,
        string_agg(m.category || ':' || l.subcategory, ',' order by m.category, l.subcategory) associated
        from {_major_sql(0.3)} m left join {_linked_sql(4, 0.3)} l on m.cluster = l.cluster and m.category = l.category
        group by 1""",
    _CLUSTERED,
)
def majority_info_query(spark, sf_dir):
    info = majority_info(emb_clustered(spark, sf_dir), 4, 0.3)
    pairs = F.flatten(F.transform(
        F.array_sort(F.map_entries("associated_subcategories")),
        lambda e: F.transform(e["value"], lambda s: F.concat_ws(":", e["key"].cast("string"), s.cast("string"))),
    ))
    return info.select("cluster", _joined("major_categories").alias("major_categories"),
                       F.array_join(pairs, ",").alias("associated"))


_WEIGHTS = """(select cluster, subcategory, counts, (1.0 / counts) / sum(1.0 / counts) over (partition by cluster) weight
    from (select cluster, subcategory, cast(count(*) as double) counts from emb_clustered group by all))"""


@query(
    "class_weights",
    f"select cluster, subcategory, cast(counts as bigint) counts, round(weight, 6) weight from {_WEIGHTS}",
    _CLUSTERED,
)
def class_weights_query(spark, sf_dir):
    return class_weights(emb_clustered(spark, sf_dir)).withColumn("weight", r6("weight"))


@query(
    "weighted_rows",
    f"""select e.vec_id, e.cluster, e.subcategory, round(w.weight, 6) weight from emb_clustered e
        join {_WEIGHTS} w on e.cluster = w.cluster and e.subcategory = w.subcategory""",
    _CLUSTERED,
)
def weighted_rows(spark, sf_dir):
    from postloom.operators.bounded import broadcast_if_small

    rows = emb_clustered(spark, sf_dir)
    weights = broadcast_if_small(class_weights(rows))
    return rows.join(weights, ["cluster", "subcategory"]).select("vec_id", "cluster", "subcategory", r6("weight").alias("weight"))


@query(
    "cluster_ranges",
    """select cluster, cast(e - n as bigint) "start", cast(e as bigint) "end" from (select cluster, count(*) n,
       sum(count(*)) over (order by cluster) e from emb_clustered group by 1)""",
    _CLUSTERED,
)
def cluster_ranges_query(spark, sf_dir):
    return cluster_ranges(emb_clustered(spark, sf_dir))


def _episodes_sql(n_way, n_support, n_query, threshold):
    draw = n_support + n_query
    return f"""select * from (with
      candidates as (select w.cluster, w.subcategory, w.weight, k.majors, l.subcategory is not null major
        from {_WEIGHTS} w join (select cluster, count(*) majors from {_major_sql(threshold)} group by 1) k
          on w.cluster = k.cluster
        left join (select distinct cluster, subcategory from {_linked_sql(draw, threshold)}) l
          on w.cluster = l.cluster and w.subcategory = l.subcategory where w.counts >= {draw}),
      first_pick as (select *, major and row_number() over (partition by cluster order by major desc,
          md5('42:' || cluster || ':major:' || subcategory), subcategory) <= least({n_way}, majors) one
        from candidates),
      pick as (select cluster, subcategory, weight, case when one then 1 else 2 end phase from (
        select *, row_number() over (partition by cluster order by one,
          md5('42:' || cluster || ':rest:' || subcategory), subcategory) rest from first_pick)
        where one or rest <= {n_way}),
      drawn as (select e.cluster, e.subcategory, e.vec_id, p.weight, p.phase, row_number() over (
          partition by e.cluster, e.subcategory order by md5('42:' || e.cluster || ':' || e.vec_id), e.vec_id) pos
        from emb_clustered e join pick p on e.cluster = p.cluster and e.subcategory = p.subcategory)
      select cluster, case when phase = 1 and pos <= {n_support} then 'support' else 'query' end as role, phase,
        subcategory, pos, vec_id, round(weight, 6) weight from drawn
      where (phase = 1 and pos <= {draw}) or pos <= {n_query})"""


def _register_episodes(name, n_way, n_support, n_query, threshold):
    @query(name, _episodes_sql(n_way, n_support, n_query, threshold), _CLUSTERED)
    def run(spark, sf_dir):
        rows = emb_clustered(spark, sf_dir)
        out = few_shot_episodes(rows, n_way, n_support, n_query, threshold=threshold)
        return out.withColumn("weight", r6("weight"))


_register_episodes("few_shot_episodes", 2, 2, 2, 0.05)
_register_episodes("few_shot_episodes_wide", 3, 3, 2, 0.3)
