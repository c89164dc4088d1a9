"""Registration of queries and the views they share, in Spark and in SQL.

The views add what the given tables lack: markup for cleaning, a label lookup with gaps,
splits, and clusters around fixed seeds so that SQL can reproduce them.  No view drops or
shortens a row.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions.hashing import uniform
from postloom.operators.cluster import nearest_centroid
from postloom.operators.sampling import hash_split
from postloom.sources.tables import spread

QUERIES: dict = {}
ORACLES: dict = {}
N_SEEDS = 8


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under ``name`` with its check, built on the named SQL views."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in _closure(views))
            ORACLES[name] = f"with {ctes} {sql}" if ctes else sql
        return fn
    return register


def _closure(views):
    ordered = []
    for v in views:
        for needed in (*_closure(NEEDS.get(v, ())), v):
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, spread over the cores."""
    return spread(table(spark, sf_dir, name))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster; a local one in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="postloom-")
    return f"{shared}/postloom-{uuid.uuid4().hex}"


# --- SQL fragments -------------------------------------------------------------------


def u_sql(key: str, salt: str = "42") -> str:
    return f"cast(cast('0x'||substr(md5('{salt}:'||{key}),1,8) as bigint) as double)/4294967296"


def sq_sql(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({a}::double[],{b}::double[]), "
        "lambda z: (z[1]-z[2])*(z[1]-z[2])))"
    )


def l2_sql(a: str, b: str) -> str:
    return f"sqrt({sq_sql(a, b)})"


def unit_sql(v: str) -> str:
    return (
        f"list_transform({v}::double[], lambda x: case when list_sum(list_transform({v}::double[], lambda y: y*y)) > 0 "
        f"then x / sqrt(list_sum(list_transform({v}::double[], lambda y: y*y))) else 0.0 end)"
    )


NEEDS = {
    "labelled": ("posts", "lookup"),
    "seeds": ("emb",),
    "emb_clustered": ("emb", "seeds"),
    "train": ("emb_clustered",),
    "test": ("emb_clustered",),
    "knn": ("train", "test"),
    "predictions": ("knn", "test"),
    "label_counts": ("train",),
}

VIEWS = {
    "posts": """select cast(doc_id as varchar) id, source subreddit, split_part(text, chr(10), 1) title,
        text selftext from documents""",
    "lookup": """select distinct source subreddit, 'cat' || (cast(substr(source,4) as int) % 5) category_1,
        source category_2, cast(null as varchar) category_3, 'true' in_data,
        cast(null as varchar) reason_for_exclusion
        from documents where source not in ('src18','src19')""",
    "labelled": """select p.id, p.subreddit, p.title, p.selftext as text, l.category_1 category,
        l.category_2 subcategory from posts p left join lookup l on p.subreddit = l.subreddit""",
    "dirty_posts": """select doc_id id, case doc_id % 8
        when 0 then concat('<lb>', text, ' [the link](http://e.com/a?b=1) end<lb>')
        when 1 then concat('note [0] ', text, ' [a [b] c] --- tail ==')
        when 2 then concat('x &# y #cool : z | ', text, ' {} ')
        when 3 then concat('u/someone in r/place ', text)
        when 4 then concat('inter- national  12- ab ', text, ' see https://e.com/p?q=1 or www.e.org/x now')
        when 5 then concat('- lead ', text, ' trail -')
        when 6 then concat('caf&eacute; &lt;b&gt;bold&lt;/b&gt; &amp;amp; ', text, ' “it’s”')
        else text end text from documents""",
    "emb": f"""select vec_id, embedding v, label subcategory, cast(floor(label/3) as int) category,
        case when u < 0.8 then 'train' when u < 0.9 then 'test' else 'validation' end split
        from (select *, {u_sql('vec_id')} u from embeddings)""",
    "seeds": f"""select cluster, v centroid from (
        select cast(row_number() over (order by {u_sql('vec_id', 'seed')}, vec_id) - 1 as int) cluster, v
        from emb where split = 'train') where cluster < {N_SEEDS}""",
    "emb_clustered": f"""select vec_id, v, subcategory, category, split, cluster from (
        select e.*, s.cluster, row_number() over (partition by vec_id
            order by {sq_sql('e.v', 's.centroid')}, s.cluster) rk
        from emb e cross join seeds s) where rk = 1""",
    "train": "select * from emb_clustered where split = 'train'",
    "test": "select * from emb_clustered where split = 'test'",
    "knn": f"""select * from (select cluster, query_id, row_number() over (partition by query_id
            order by sq_dist, neighbor_id) rank, neighbor_id, sq_dist, subcategory from (
        select q.cluster, q.vec_id query_id, b.vec_id neighbor_id, {sq_sql('q.v', 'b.v')} sq_dist, b.subcategory
        from test q join train b on q.cluster = b.cluster)) where rank <= 5""",
    "predictions": """select t.vec_id, t.cluster, t.subcategory truth, w.subcategory prediction
        from test t left join (select query_id, subcategory, row_number() over (partition by query_id
            order by s desc, r) rk from (select query_id, subcategory, sum(1/(sq_dist+1e-5)) s, min(rank) r
            from knn group by all)) w on t.vec_id = w.query_id and w.rk = 1""",
    "label_counts": "select cluster, subcategory, count(*) counts from train group by all",
}

# --- the same views in Spark ---------------------------------------------------------


def posts(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("subreddit"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("selftext"),
    )


def lookup(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("string")
    group = F.substring("source", 4, 9).cast("int") % 5
    return (
        table(spark, sf_dir, "documents")
        .select("source").where(~F.col("source").isin("src18", "src19")).distinct()
        .select(
            F.col("source").alias("subreddit"),
            F.concat(F.lit("cat"), group.cast("string")).alias("category_1"),
            F.col("source").alias("category_2"),
            none.alias("category_3"),
            F.lit("true").alias("in_data"),
            none.alias("reason_for_exclusion"),
        )
    )


def dirty_posts(spark, sf_dir) -> DataFrame:
    text = F.col("text")
    wrapped = [
        ("<lb>", " [the link](http://e.com/a?b=1) end<lb>"),
        ("note [0] ", " [a [b] c] --- tail =="),
        ("x &# y #cool : z | ", " {} "),
        ("u/someone in r/place ", ""),
        ("inter- national  12- ab ", " see https://e.com/p?q=1 or www.e.org/x now"),
        ("- lead ", " trail -"),
        ("caf&eacute; &lt;b&gt;bold&lt;/b&gt; &amp;amp; ", " “it’s”"),
    ]
    dirty = text
    for i, (before, after) in enumerate(wrapped):
        dirty = F.when(F.col("doc_id") % 8 == i, F.concat(F.lit(before), text, F.lit(after))).otherwise(dirty)
    return texts(spark, sf_dir).select(F.col("doc_id").alias("id"), dirty.alias("text"))


def emb(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("v"), F.col("label").alias("subcategory"),
        F.floor(F.col("label") / 3).cast("int").alias("category"),
    )
    return hash_split(rows, "vec_id")


def seeds(spark, sf_dir) -> DataFrame:
    """The initial centroids: the first vectors of a shuffle, numbered from 0."""
    u = uniform(F.col("vec_id"), "seed")
    chosen = (
        emb(spark, sf_dir).where("split = 'train'").withColumn("u", u)
        .orderBy("u", "vec_id").limit(N_SEEDS)
    )
    place = F.row_number().over(Window.orderBy("u", "vec_id")) - 1  # over N_SEEDS rows
    return chosen.select(place.cast("int").alias("cluster"), F.col("v").alias("centroid"))


def emb_clustered(spark, sf_dir) -> DataFrame:
    return nearest_centroid(emb(spark, sf_dir), seeds(spark, sf_dir))


def train_test(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = emb_clustered(spark, sf_dir)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def r6(column):
    return F.round(column, 6)
