"""The trie, the ranked list and sorted parts against plain Python."""

import random

import pytest
from llm import brute
from pyspark.sql import functions as F

from postloom.llm import conversation_trie, list_ranking
from postloom.llm.conversation_trie import _listed_digests, conversation_trie as trie, number_turns, prefix_trie
from postloom.llm.list_ranking import rank_list
from postloom.llm.queries import _rebuilt, op11_conversation_trie
from postloom.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, n=60):
    draw = random.Random(seed)
    out = []
    for conv in [*range(n), *range(2001, 2012), -3, -20, -25, 2**62]:
        for turn in range(draw.choice([1, 1, 2, 3, 6])):
            text = draw.choice(["", None, "hello", "hello there", "a b c", f"own {conv}"])
            out.append((conv, draw.choice([turn, turn, None, 0]), draw.choice(["user", "assistant", None, ""]), text))
    return out + [(None, 1, "user", "nobody"), (None, None, None, None), out[3], out[3], out[0]]


@pytest.fixture
def small(monkeypatch):
    """Short lists, runs and chunks, so that all steps are taken on small tables."""
    monkeypatch.setattr(list_ranking, "FINISH", 20)
    monkeypatch.setattr(list_ranking, "EVERY", 4)
    monkeypatch.setattr(conversation_trie, "RUN", 16)
    monkeypatch.setattr(conversation_trie, "CHUNK", 4)


def test_trie_same_as_plain_python(spark, small):
    rows = conversations(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("a", F.lit(1)).repartition(4)
    assert rows_of(trie(df)) == brute.trie(brute.turns_in_order(rows))


def test_rebuilt_families(spark, small):
    rows = conversations(2)
    scratch = Scratch(spark)
    turns, members = _rebuilt(number_turns(spark.createDataFrame(rows, SCHEMA), scratch))
    want = brute.families(brute.turns_in_order(rows))
    assert any(not t for t in want.values())
    assert rows_of(prefix_trie(turns, members, scratch)) == brute.trie(want)


def test_one_long_conversation_and_one_hot_turn(spark):
    """A third of all rows are one conversation's, a third one and the same turn: both reach over many parts."""
    rows = [(7, None, "user", "again and again") for _ in range(300)]
    rows += [(100 + i, 0, "user", "hi") for i in range(300)] + [(100 + i, 1, "user", f"q {i}") for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scratch = Scratch(spark)
    numbered = number_turns(df, scratch)
    assert numbered.where("conv_id = 7").select("_part").distinct().count() >= 2
    assert sorted(r.place for r in numbered.where("conv_id = 7").collect()) == list(range(1, 301))
    assert numbered.groupBy("_part").count().agg(F.max("count")).first()[0] < 300
    assert rows_of(trie(df)) == brute.trie(brute.turns_in_order(rows))


def test_copies_by_the_hundred(spark, small):
    rows = [(c, t, "user", f"t{t}") for c in range(200) for t in range(3)]
    assert rows_of(trie(spark.createDataFrame(rows, SCHEMA))) == brute.trie(brute.turns_in_order(rows))


def test_no_rows_and_rows_without_conversation(spark):
    assert rows_of(trie(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_very_long_text_and_odd_types(spark):
    rows = [(1, 0, "user", "w " * 200_000), (2, 0, "user", "w " * 200_000), (3, 0, "user", "w " * 200_000 + "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert rows_of(trie(df)) == brute.trie(brute.turns_in_order(rows))


def test_members_without_turns(spark):
    turns = spark.createDataFrame([], "conv_id long, depth long, turn_hash string, words long")
    members = spark.createDataFrame([(5,), (3,), (None,)], "conv_id long")
    assert rows_of(prefix_trie(turns, members)) == brute.trie({5: [], 3: []})


@pytest.mark.parametrize("n", [1, 2, 30, 700])
def test_ranks_of_a_shuffled_list(spark, small, n):
    draw = random.Random(n)
    order = draw.sample(range(10 * n), n)
    gaps = [draw.randint(0, 9) for _ in order]
    links = [(x, order[i - 1] if i else None, gaps[i]) for i, x in enumerate(order)]
    draw.shuffle(links)
    got = {r.id: r["rank"] for r in rank_list(spark.createDataFrame(links, "id long, prev long, gap long"), Scratch(spark)).collect()}
    assert got == {x: sum(gaps[:i + 1]) for i, x in enumerate(order)}


def test_no_links_rings_and_two_lists(spark, small):
    kind = "id string, prev string, gap int"
    assert rank_list(spark.createDataFrame([], kind), Scratch(spark)).collect() == []
    two = [(f"a{i}", f"a{i - 1}" if i else None, 1) for i in range(30)] + [(f"b{i}", f"b{i - 1}" if i else None, 1) for i in range(30)]
    with pytest.raises(ValueError, match="one first"):
        rank_list(spark.createDataFrame(two, kind), Scratch(spark))
    with pytest.raises(Exception, match="not one list"):
        rank_list(spark.createDataFrame([("a", None, 1), ("b", "c", 1), ("c", "b", 1)], kind), Scratch(spark)).collect()


def test_digests_over_batches(spark, small):
    import hashlib

    ends = spark.createDataFrame([(i % 3, -1, 2, i * 7 - 50) for i in range(500)], "a long, b long, depth long, conv_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows_of(_listed_digests(ends))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, -1, 2, hashlib.sha256(",".join(str(i * 7 - 50) for i in range(500) if i % 3 == k).encode()).hexdigest()) for k in range(3)]
    assert got == want


def test_query_on_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = brute.trie(brute.families(brute.turns_in_order([tuple(r) for r in df.collect()])))
    assert rows_of(op11_conversation_trie(spark, sf)) == want
