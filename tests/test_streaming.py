"""Streams that fail in between, and posts with broken records."""

import pytest
from pyspark.sql import functions as F

from postloom.operators.cluster import fit_clusters, predict_clusters
from postloom.operators.knn import knn_join
from postloom.registry.base import emb
from postloom.sources.tables import read_posts_checked
from postloom.streaming.batches import knn_stream, predict_stream, read_batches, write_batches

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def arriving(spark, tmp_path):
    rows = emb(spark, SF).select("vec_id", "v", "subcategory")
    rows.where("vec_id < 90").repartition(3, "vec_id").write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_a_restart_neither_loses_nor_repeats_rows(spark, arriving, tmp_path):
    tries = []

    def fails_once(batch):
        tries.append(batch.count())
        if len(tries) == 2:
            # Half of the batch is written when the job dies.
            batch.limit(3).withColumn("n", F.lit(0)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=1")
            raise RuntimeError("lost")
        return batch.select("vec_id").withColumn("n", F.lit(1))

    first = write_batches(arriving, fails_once, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match="lost"):
        first.awaitTermination()
    write_batches(arriving, fails_once, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = read_batches(spark, f"{tmp_path}/out")
    assert rows_of(got.select("vec_id", "n")) == sorted([(i, 1) for i in range(90)], key=str)
    assert got.select("batch").distinct().count() == 3 and len(tries) == 4
    write_batches(arriving, fails_once, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert read_batches(spark, f"{tmp_path}/out").count() == 90 and len(tries) == 4


def test_clusters_and_neighbours_of_a_stream(spark, arriving, tmp_path):
    rows = emb(spark, SF).select("vec_id", "v", "subcategory")
    model = fit_clusters(rows, n_clusters=4, n_components=4)
    predict_stream(arriving, model, f"{tmp_path}/a", f"{tmp_path}/ca").awaitTermination()
    want = predict_clusters(rows.where("vec_id < 90"), model).select("vec_id", "cluster")
    assert rows_of(read_batches(spark, f"{tmp_path}/a").select("vec_id", "cluster")) == rows_of(want)
    base = rows.where("vec_id >= 90")
    knn_stream(arriving, base, f"{tmp_path}/b", f"{tmp_path}/cb", k=3, by=None).awaitTermination()
    want = knn_join(rows.where("vec_id < 90"), base, k=3, by=None).select("query_id", "rank", "neighbor_id")
    assert rows_of(read_batches(spark, f"{tmp_path}/b").select("query_id", "rank", "neighbor_id")) == rows_of(want)


@pytest.mark.parametrize("multiline", [True, False])
def test_broken_records_are_listed_and_good_ones_arrive(spark, tmp_path, multiline):
    head = "id\tsubreddit\ttitle\tselftext\n"
    (tmp_path / "a.tsv").write_text(head + "1\ta\tt\thello\n2\ta\tonly three\n3\ta\tt\t\"quoted \"\"text\"\"\"\n")
    (tmp_path / "b.tsv").write_text(head + "4\tb\tt\tx\tone more\n5\tb\t\ty\n")
    posts, rejects, counts = read_posts_checked(spark, str(tmp_path), multiline=multiline)
    good = {r.id: r for r in posts.collect()}
    assert sorted(good) == ["1", "3", "5"] and good["3"].selftext == 'quoted "text"' and good["5"].title is None
    assert counts.get == {"posts": 3, "rejects": 2}
    bad = {r.record.strip(): r for r in rejects.collect()}
    assert sorted(bad) == ["2\ta\tonly three", "4\tb\tt\tx\tone more"]
    assert bad["2\ta\tonly three"].file.endswith("a.tsv") and bad["2\ta\tonly three"].fields[:3] == ["2", "a", "only three"]
    (tmp_path / "c.tsv").write_text(head)
    assert read_posts_checked(spark, str(tmp_path / "c.tsv"), multiline=multiline)[0].collect() == []
