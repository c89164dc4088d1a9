"""Jobs that turn raw posts into clean splits, and splits into embeddings."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.operators.embed import BATCH_SIZE, HASH_DIM, embed_text, learn_vocabulary, tokenize
from postloom.operators.labels import label_encode, label_vocabulary
from postloom.operators.relational import enrich, select_mapped
from postloom.operators.sampling import hash_split, random_split
from postloom.sources.tables import read_lookup, read_posts, read_splits, spread, write_splits


def preprocess(df: DataFrame, text: str = "text", name: str = "clean_text", mask_mentions: bool = False) -> DataFrame:
    """Add the cleaned and normalised text."""
    return df.withColumn(name, tx.normalize_text(tx.clean(F.col(text), mask_mentions)))


def keep_clean(df: DataFrame) -> DataFrame:
    """``text`` becomes ``raw_text``, ``clean_text`` becomes ``text``; a helper column
    ``impurity`` is dropped."""
    return df.withColumnsRenamed({"text": "raw_text", "clean_text": "text"}).drop("impurity")


def labelled_posts(posts: DataFrame, lookup: DataFrame) -> DataFrame:
    return select_mapped(enrich(posts, lookup))


def prepare_posts(
    spark: SparkSession,
    posts_path: str,
    lookup_path: str,
    out_path: str | None = None,
    seed: int = 42,
    num_files: int | None = None,
    exact: bool = True,
    multiline: bool = True,
) -> DataFrame:
    """Read, label, clean and split posts; write one folder per split if a path is given.

    Exact split sizes take a few passes over the keys, which for delimited text means
    parsing it again (cleaning is left out of those passes by Catalyst).  With
    ``exact=False`` the sizes are expected ones and the files are read once.  Posts may hold
    line breaks; ``multiline=False`` reads files of one line per post in splits and fails on a
    post that is broken over lines.
    """
    # Spread before the join: asking for a join's partitions would run it.
    posts = labelled_posts(spread(read_posts(spark, posts_path, multiline=multiline)), read_lookup(spark, lookup_path))
    cleaned = preprocess(posts)
    split = random_split(cleaned, "id", seed=seed) if exact else hash_split(cleaned, "id", seed=seed)
    if out_path is None:
        return split
    write_splits(split, out_path, num_files)
    return read_splits(spark, out_path)


def prepare_embeddings(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    splits=None,
    make_predict_fn: Callable | None = None,
    batch_size: int = BATCH_SIZE,
    num_files: int | None = None,
    max_length: int | None = None,
    dim: int = HASH_DIM,
) -> DataFrame:
    """Encode labels, tokenise, embed and write the splits.

    Label vocabularies and the token vocabulary are learned from the train split; a label
    that train does not have is an error, as is a null one left null.
    """
    df = spread(read_splits(spark, in_path, splits))
    train = spread(read_splits(spark, in_path, ["train"]))
    combined = tx.combine_title_text(F.col("title"), F.col("text"))
    vocabulary = learn_vocabulary(train.select(combined.alias("_combined")), "_combined")
    for label in ("category", "subcategory"):
        df = label_encode(df, label, label_vocabulary(train, label))
    df = tokenize(df.withColumn("_combined", combined), vocabulary, "_combined", max_length=max_length)
    df = embed_text(df, "_combined", make_predict_fn, batch_size, dim).drop("_combined")
    write_splits(df, out_path, num_files)
    return read_splits(spark, out_path)
