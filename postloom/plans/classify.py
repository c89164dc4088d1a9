"""Zero-shot and supervised classification jobs."""

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.cluster import ClusterModel, as_ml_vector, fit_clusters, predict_clusters
from postloom.operators.evaluate import evaluate
from postloom.operators.knn import knn_join
from postloom.operators.lineage import cut_lineage
from postloom.operators.sampling import sample_n
from postloom.operators.vote import vote_majority, vote_weighted
from postloom.sources.tables import save_model, write_vectors


def classify_clustered(
    train: DataFrame,
    test: DataFrame,
    k: int = 5,
    weighted: bool = True,
    key: str = "vec_id",
    vec: str = "v",
    label: str = "subcategory",
) -> DataFrame:
    """(key, cluster, truth, prediction): vote of the k nearest training rows of the same
    cluster.  A test row whose cluster has no training rows keeps a null prediction."""
    near = knn_join(test, train, k=k, by="cluster", key=key, vec=vec, carry=(label,))
    vote = vote_weighted if weighted else vote_majority
    votes = vote(near, label).select(F.col("query_id").alias(key), "prediction")
    return test.select(key, "cluster", F.col(label).alias("truth")).join(votes, key, "left")


def classify_zero_shot(
    train: DataFrame,
    test: DataFrame,
    train_samples_ratio: float = 0.25,
    seed: int = 42,
    k: int = 5,
    model_path: str | None = None,
    model: ClusterModel | None = None,
    work_path: str | None = None,
    key: str = "vec_id",
    vec: str = "v",
    label: str = "subcategory",
    **fit_options,
) -> tuple[DataFrame, DataFrame, ClusterModel]:
    """Sample the training rows, cluster them, classify the test rows by their neighbours.

    Returns (predictions, one row of metrics, model).  The model is stored at
    ``model_path`` if given.  Clustered rows are stored, at ``work_path`` if given and as a
    checkpoint otherwise: sample, reduction and assignment run once, group sizes are counted
    from the stored column, and a lost executor does not bring them back.
    """
    sample = sample_n(train, key, ratio=train_samples_ratio, seed=seed)
    if model is None:
        model = fit_clusters(sample, key, vec, seed=seed, **fit_options)
    if model_path is not None:
        save_model(train.sparkSession, model, model_path)
    clustered = {"train": predict_clusters(sample, model, vec), "test": predict_clusters(test, model, vec)}
    for name, rows in clustered.items():
        rows = rows.select(key, vec, label, "cluster")
        if work_path is None:
            clustered[name] = cut_lineage(rows)
        else:
            write_vectors(rows, f"{work_path}/{name}")
            clustered[name] = train.sparkSession.read.parquet(f"{work_path}/{name}")
    predictions = classify_clustered(
        clustered["train"], clustered["test"], k=k, key=key, vec=vec, label=label
    )
    return predictions, evaluate(predictions), model


def train_category_classifier(
    df: DataFrame, label: str = "category", vec: str = "embedding", max_iter: int = 100, reg: float = 0.0
) -> LogisticRegressionModel:
    """Multinomial logistic regression on embeddings; labels are indexes from 0."""
    ready = as_ml_vector(df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()), vec)
    learner = LogisticRegression(
        featuresCol="_vector", labelCol=label, maxIter=max_iter, regParam=reg, family="multinomial"
    )
    # Kept while fitting: the learner reads its input more than once, and vectors that are
    # still to be embedded would be computed each time.
    ready = ready.select("_vector", F.col(label).cast("double").alias(label)).persist()
    try:
        return learner.fit(ready)
    finally:
        ready.unpersist()


def predict_categories(df: DataFrame, model: LogisticRegressionModel, label: str = "category", vec: str = "embedding") -> DataFrame:
    """Add ``truth`` and ``prediction`` (the label with the highest score) as ints."""
    scored = model.copy({model.predictionCol: "_best"}).transform(as_ml_vector(df, vec))
    return (
        scored.withColumn("truth", F.col(label).cast("int"))
        .withColumn("prediction", F.col("_best").cast("int"))
        .drop("_vector", "_best", "rawPrediction", "probability")
    )
