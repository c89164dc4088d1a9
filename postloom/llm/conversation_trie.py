"""The prefix trie of conversations, with sums over subtrees from an Euler tour.

A node is a distinct sequence of first turns.  It is found by the exclusive or of one 128-bit hash per
(place, turn), a running value over each conversation, and named by its smallest member and its depth:
no two nodes have the same name, since a conversation has one prefix of each length.

Every node gives an arc that enters and an arc that leaves it.  Children follow in the order of their
names.  Entering a node is followed by entering its first child, or by leaving it; leaving it by
entering its next sibling, or by leaving its parent.  One sort puts every node in front of its children
and gives all four.  The tour is ranked as a linked list (see ``list_ranking``); what the nodes of a
subtree have together is the difference of running sums at the two arcs of its top.

Running values are computed per part of a sort (see ``parts``), so that one conversation, or one
node's children, may hold any share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.list_ranking import rank_list
from postloom.llm.parts import earlier_parts, in_part, sorted_parts, spanning, with_carried
from postloom.llm.scratch import Scratch, tasks

WORDS = r"[^\x20\x09-\x0D]+"
#: Characters of role and text that order turns of one number, arcs whose sums are run up in one task, ids in one chunk.
TIE, RUN, CHUNK = 64, 1 << 16, 1 << 12
NODE, PREFIX = ["conv_id", "depth"], ["a", "b"]


def number_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, place, turn_hash, words) of every turn, places from 1.

    Turns go by ``turn``, null first; equal ones by the first 64 characters of role and text, then by
    their hash.  Null role or text counts as empty; repeated rows are turns of their own.  Rows without a
    conv_id belong to no conversation and are left out.  Other columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    both = F.concat(role, F.lit("\x01"), text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.left(both, F.lit(TIE)).alias("tie"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),  # keeps apart rows that are alike: any order of them will do
    )
    group, order = ["conv_id"], [F.col("turn").asc_nulls_first(), "tie", "turn_hash", "row"]
    parts = sorted_parts(turns, group, order, scratch)
    before = spanning(parts, group, F.count("*").alias("n")).select("_part", *group, F.sum("n").over(earlier_parts(group)).alias("before"))
    place = F.row_number().over(in_part(group, order)) + F.coalesce("before", F.lit(0))
    numbered = with_carried(parts, before, group).select("_part", "conv_id", place.cast("long").alias("place"), "turn_hash", "words")
    return scratch.keep(numbered)


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, words, a, b, pa, pb): the hash of every prefix and of the one before it.

    ``turns`` has (conv_id, depth, turn_hash, words), depths from 1 without a gap.
    """
    group, order = ["conv_id"], ["depth"]
    parts = sorted_parts(turns.select("conv_id", "depth", "turn_hash", "words"), group, order, scratch)
    term = [F.xxhash64(F.lit(seed), "depth", "turn_hash") for seed in (1, 2)]
    carried = spanning(parts, group, *[F.bit_xor(t).alias(f"sum_{x}") for t, x in zip(term, PREFIX)])
    carried = carried.select("_part", *group, *[F.bit_xor(f"sum_{x}").over(earlier_parts(group)).alias(f"before_{x}") for x in PREFIX])
    running = [F.bit_xor(t).over(in_part(group, order)).bitwiseXOR(F.coalesce(f"before_{x}", F.lit(0))).alias(x) for t, x in zip(term, PREFIX)]
    out = with_carried(parts, carried, group).select("conv_id", "depth", "words", "turn_hash", *running)
    before = [F.col(x).bitwiseXOR(t).alias(f"p{x}") for t, x in zip(term, PREFIX)]
    return out.select("conv_id", "depth", "words", *PREFIX, *before)


def _families(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node once in front of its children (kind 0) and once among its parent's (kind 1), with the
    conversation that follows in this order and, among its parent's children, the parent's."""
    group, order = ["a", "b", "top"], ["kind", "conv_id"]
    own = nodes.select("a", "b", F.col("depth").alias("top"), F.lit(0).alias("kind"), "conv_id", "depth")
    child = nodes.where("depth > 0").select(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("top"), F.lit(1).alias("kind"), "conv_id", "depth")
    parts = sorted_parts(own.unionAll(child), group, order, scratch)
    parent = F.when(F.col("kind") == 0, F.col("conv_id"))
    ends = spanning(parts, group, F.min(F.struct("kind", "conv_id")).alias("first"), F.max(parent).alias("top_conv"))
    rows = Window.partitionBy(*group).orderBy("_part")
    ends = ends.select("_part", *group, F.lead("first.conv_id").over(rows).alias("next_part"), F.max("top_conv").over(Window.partitionBy(*group)).alias("spanning_parent"))
    window = in_part(group, order)
    here = parts.withColumn("follows", F.lead("conv_id").over(window)).withColumn("local_parent", F.first(parent).over(window))
    return scratch.keep(with_carried(here, ends, group).select(
        "kind", "conv_id", "depth", F.coalesce("follows", "next_part").alias("follows"), F.coalesce("local_parent", "spanning_parent").alias("parent_conv_id")))


def _arc(conv, depth, side: int):
    return F.struct(conv.cast("long").alias("conv_id"), depth.cast("long").alias("depth"), F.lit(side).alias("side"))


def _tour(families: DataFrame) -> DataFrame:
    """Links (id, prev, gap) of the tour; side 0 enters a node, side 1 leaves it."""
    conv, depth, follows = F.col("conv_id"), F.col("depth"), F.col("follows")
    down = families.where("kind = 0").select(
        _arc(conv, depth, 0).alias("prev"), F.when(follows.isNotNull(), _arc(follows, depth + 1, 0)).otherwise(_arc(conv, depth, 1)).alias("id"))
    up = families.where("kind = 1").select(
        _arc(conv, depth, 1).alias("prev"),
        F.when(follows.isNotNull(), _arc(follows, depth, 0)).otherwise(_arc(F.col("parent_conv_id"), depth - 1, 1)).alias("id"))
    links = down.unionAll(up).select("id", "prev", F.lit(1).alias("gap"))
    start = families.where("kind = 0 and depth = 0").select(_arc(conv, depth, 0).alias("id"), F.lit(None).cast(links.schema["prev"].dataType).alias("prev"), F.lit(0).alias("gap"))
    return links.unionAll(start)


def _subtree_sums(places: DataFrame, values: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, subtree): running sums at the two arcs of every node, subtracted.

    ``places`` has every arc's rank, ``values`` each node's (leaf, saved), which count where it is entered.
    """
    at = places.select("id.conv_id", "id.depth", "id.side", "rank", F.floor(F.col("rank") / RUN).alias("run"))
    own = [F.when(F.col("side") == 0, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")]
    at = at.join(values, NODE).select(*NODE, "side", "rank", "run", *own)
    runs = at.groupBy("run").agg(F.sum("leaf").alias("run_leaf"), F.sum("saved").alias("run_saved"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row for 65 536 arcs
    runs = runs.select("run", *[F.coalesce(F.sum(f"run_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in ("leaf", "saved")])
    within = Window.partitionBy("run").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.join(runs, "run").select(
        *NODE, "side", *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"before_{c}")).alias(c) for c in ("leaf", "saved")])
    sign = F.when(F.col("side") == 0, -1).otherwise(1)
    return sums.groupBy(*NODE).agg(F.sum(sign * F.col("leaf")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("subtree"))


def _listed_digests(ends: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256): the digest of the ids that end at each node, ascending, comma-joined.

    Ids gather in chunks of at most 4096; a node's chunks pass one task in order, one at a time.
    """
    key = [*PREFIX, "depth"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*key, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(text.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = state = None
        for batch in batches:
            done = []
            rows = zip(*(batch.column(c).to_pylist() for c in key), batch.column("ids"))
            for *name, ids in rows:
                if name != open_key:
                    if state is not None:
                        done.append((*open_key, state.hexdigest()))
                    open_key, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            if done:
                yield _batch(done)
        if state is not None:
            yield _batch([(*open_key, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*key, "ends_sha256"])

    ordered = chunks.repartition(tasks(ends.sparkSession), *key).sortWithinPartitions(*key, "chunk")
    return ordered.mapInArrow(digest, "a long, b long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per node of the trie of all members' sequences.

    ``turns``: (conv_id, depth, turn_hash, words), depths from 1 without a gap and each once; turns are the
    same where their hashes are.  ``members``: (conv_id), every conversation once, with or without turns.

    Returns conv_id (smallest member), depth (0 for the root), parent_conv_id (null for the root), n_convs,
    n_children, n_leaves and saved_tokens of the subtree with its top (words of a node's last turn for every
    member but one), ends_sha256.  No members: no rows.  Null ids belong to no conversation.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "words", "a", "b", "pa", "pb")]
    members = members.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), *zero)
    rows = scratch.keep(prefixes(turns, scratch).unionByName(members))
    key = [*PREFIX, "depth"]
    nodes = scratch.keep(rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb")))
    families = _families(nodes, scratch)
    places = rank_list(_tour(families), scratch)
    leaves = families.where("kind = 0").select(*NODE, F.col("follows").isNull().cast("long").alias("leaf"))
    saved = nodes.select(*NODE, ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = _subtree_sums(places, leaves.join(saved, NODE))
    child = families.where("kind = 1")
    children = child.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", *PREFIX)).alias("end")).select("conv_id", "end.*")
    out = (
        nodes.join(_listed_digests(ends), key, "left").join(child.select(*NODE, "parent_conv_id"), NODE, "left")
        .join(children, NODE, "left").join(sums, NODE)
    )
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        F.col("subtree").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; see ``prefix_trie``, ``number_turns``."""
    scratch = Scratch(conversations.sparkSession)
    numbered = number_turns(conversations, scratch)
    return prefix_trie(numbered.withColumnRenamed("place", "depth"), numbered.select("conv_id").distinct(), scratch)
