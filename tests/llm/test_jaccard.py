"""The Jaccard join against brute force."""

import random

import pytest
from llm import brute

from postloom.llm import jaccard_join
from postloom.llm.jaccard_join import jaccard_classes

SCHEMA = "doc_id long, text string"


def near_copies(seed=3):
    """Random texts, exact copies, edited copies, texts around a shared passage, odd rows."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 4)))
    rows, passage = [], " ".join(word() for _ in range(30))
    for _ in range(25):
        rows.append(" ".join(word() for _ in range(draw.randint(1, 60))))
    for base in rows[:12]:
        for _ in range(draw.randint(0, 8)):
            words = base.split()
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = word()
            rows.append((" " if draw.random() < 0.5 else "\t\n").join(words).upper() if draw.random() < 0.3 else " ".join(words))
    for _ in range(40):
        rows.append(passage + " " + " ".join(word() for _ in range(draw.randint(0, 12))))
    rows += [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f", "x\x1cy z", "é É ü"]
    draw.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in jaccard_classes(df).collect()), key=str)


def test_same_as_brute_force(spark):
    rows = near_copies()
    assert run(spark, rows) == brute.jaccard_classes(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST", 0)
    rows = near_copies(4)
    assert run(spark, rows) == brute.jaccard_classes(rows)


def test_empty_blocks_of_few_long_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 60)
    rows = []
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(100)]
        for copy in range(2 + group % 2):
            rows.append((len(rows), " ".join([*words, *["x", "y", "z"][:copy]])))
    assert run(spark, rows) == brute.jaccard_classes(rows)


def test_null_keys_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "A b c d e f"), (9, "z")]
    assert run(spark, rows) == brute.jaccard_classes(rows)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", 3)], "doc_id long, text string, n int, cls string, root int")
    assert [tuple(r) for r in jaccard_classes(df).collect()] == [(1, 1, 1, 0)]


@pytest.mark.parametrize("percent", [60, 90])
def test_other_thresholds(spark, percent):
    rows = near_copies(5)
    got = sorted((tuple(r) for r in jaccard_classes(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()), key=str)
    assert got == brute.jaccard_classes(rows, percent)
