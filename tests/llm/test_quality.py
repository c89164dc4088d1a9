"""Quality counts against brute force, and the likelihood ratio on plain and foreign texts."""

import random

import numpy as np
from llm import brute
from pyspark.sql import functions as F

from postloom.llm.quality import BUCKETS, fit_quality, judge_quality

SCHEMA = "doc_id int, text string, good boolean"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def texts():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abé😀#|<") for _ in range(draw.randint(1, 4)))
    rows = [None, "", " \n \n", "\n\na\na\n a\n", "a b c d e f g h " * 10, "x" * 10_000, "#" * 3000, "w " * 4000]
    for _ in range(80):
        lines = [" ".join(word() for _ in range(draw.randint(0, 14))) for _ in range(draw.randint(1, 8))]
        rows.append("\n".join(draw.choice(lines) for _ in range(draw.randint(1, 10))))
    return [(i, t, i % 3 == 0) for i, t in enumerate(rows)]


def test_counts(spark):
    df = spark.createDataFrame(texts(), SCHEMA).repartition(3)
    out = judge_quality(df, fit_quality(df, F.col("good"))).collect()
    assert {r.doc_id: tuple(r[c] for c in BASE) for r in out} == {i: brute.quality_counts(t) for i, t, _ in texts()}
    assert all(not r.kept for r in out if r.base_failed)


def test_likelihood_ratio(spark):
    draw = random.Random(4)
    plain = lambda: " ".join(draw.choice(["red", "green", "blue", "sky", "sea", "tree"]) for _ in range(draw.randint(20, 60)))
    junk = lambda: " ".join(str(draw.random()) for _ in range(40))
    rows = [(i, plain() if i % 4 else junk(), True if i % 4 and i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = fit_quality(df, F.col("good"))
    assert model.ratio.shape == (BUCKETS,) and np.isfinite(model.ratio).all()
    out = judge_quality(df, model).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in out if not r.base_failed)
    again = {r.doc_id: r.log_ratio for r in judge_quality(df.repartition(7), fit_quality(df.repartition(2), F.col("good"))).collect()}
    assert again == {r.doc_id: r.log_ratio for r in out}


def test_no_rows_no_target_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert judge_quality(none, fit_quality(none, F.col("good"))).collect() == []
    df = spark.createDataFrame([(1, "a " * 25, 7, False)], "doc_id int, text string, n_words int, kept boolean")
    row = judge_quality(df, fit_quality(df, F.lit(False))).first()
    assert row.n_words == 25 and row.log_ratio == 0.0 and not row.kept
