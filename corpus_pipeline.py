"""The corpus pipeline: five stages from documents to a training mix.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and
read again as the docs of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.decontaminate import contaminated
from postloom.llm.jaccard_join import jaccard_classes
from postloom.llm.language import fit_languages, load_pieces, predict_language
from postloom.llm.mixing import systematic_mix
from postloom.llm.pii import find_pii, fit_pii, mask
from postloom.llm.scratch import Scratch, broadcast_if_small

#: A public vocabulary for the language models.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: A document whose best language has a lower posterior is rejected.
LEAST_SCORE = 0.5

#: SQL cannot express the learned stages; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language and set ``lang`` to what was found.

    The models learn from all documents with a language.  A document without letters (null or empty
    text, signs only) or with a posterior under LEAST_SCORE goes.
    """
    found = predict_language(docs, fit_languages(docs, load_pieces(PIECES)))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each group of similar documents.

    Documents without words have no group and stay, as do rows without a doc_id; of rows that
    repeat a kept document one stays.
    """
    classes = jaccard_classes(docs)
    stay = classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_stay")).agg(F.count("*").alias("_rows"))
    again = not stay.where("_rows > 1").isEmpty()
    kept = docs.join(broadcast_if_small(stay.select("_stay")), F.col("doc_id") == F.col("_stay"), "left_semi")
    if again:
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a benchmark item."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)
    leaks = found.select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(broadcast_if_small(Scratch(spark).keep(leaks)), F.col("doc_id") == F.col("_leak"), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; ``n_chars`` follows the text."""
    found = find_pii(docs, fit_pii(docs)).withColumn("text", mask(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as the mix takes it, with the number of the copy."""
    mixed = systematic_mix(docs, weights=[3.0, 1.0, 2.0], share=1.5, ceiling=2.0)
    copies = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*docs.columns, "copy")


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if previous is not None:
            scratch.drop(previous)
        previous = docs
    return docs
