"""The place of every element of a linked list that is spread over a cluster.

Every sixteenth element or so, chosen by hash, is a ruler.  Each element jumps backwards, doubling the
way with each round by taking over the jump of the element it has reached, until it stands on a ruler;
those that do take no further part.  Stretches between rulers are short (some hundred elements at most
for billions), so few rounds do.  The rulers form a list of a sixteenth of the length with known gaps,
which is ranked in the same way; one task ranks a list of at most ``FINISH`` elements.  All steps are
joins on unique keys; written tables cut the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from postloom.llm.scratch import Scratch

#: One element in so many is a ruler; the longest list that one task ranks.
EVERY, FINISH = 16, 8192


def rank_list(links: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """(id, rank): the sum of all gaps up to each element, of links (id, prev, gap).

    ``id`` is unique, of any type that joins; the first element has a null ``prev`` and every other
    element is reached from it, or ValueError is raised.  Without links there are no ranks.
    """
    links = scratch.keep(links.select("id", "prev", F.col("gap").cast("long").alias("gap")))
    if links.count() <= FINISH:
        return scratch.keep(_walk(links))
    heads = links.where("prev is null").select("id").take(2)
    if len(heads) != 1:
        raise ValueError("a list has one first element")
    head = F.lit(None) if heads[0].id is None else _literal(links, heads[0].id)

    def ruler(id_: str) -> Column:
        return (F.pmod(F.xxhash64(F.lit(level), id_), F.lit(EVERY)) == 0) | (F.col(id_) == head)

    table = [links.where("prev is not null").select("id", F.col("prev").alias("at"), F.col("gap").alias("dist"), ruler("prev").alias("done"))]
    while True:
        moving = table[-1].where("not done")
        if moving.isEmpty():
            break
        state = reduce(DataFrame.unionAll, [t.where("done") for t in table] + [moving])
        reached = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("dist").alias("more"), F.col("done").alias("arrived"))
        jumped = moving.join(reached, "at").select("id", F.col("next").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), F.col("arrived").alias("done"))
        table.append(scratch.keep(jumped))
        if len(table) > 64:
            raise ValueError("links that form a ring")
    state = reduce(DataFrame.unionAll, [t.where("done") for t in table])
    rulers = state.where(ruler("id")).select("id", F.col("at").alias("prev"), F.col("dist").alias("gap"))
    first = links.where("prev is null")
    ranked = rank_list(rulers.unionAll(first), scratch, level + 1)
    others = state.where(~ruler("id")).join(ranked.select(F.col("id").alias("at"), "rank"), "at").select("id", (F.col("rank") + F.col("dist")).alias("rank"))
    out = scratch.keep(ranked.unionAll(others))
    scratch.drop(links, *table[1:])
    return out


def _literal(links: DataFrame, value) -> Column:
    kind = links.schema["id"].dataType
    if isinstance(kind, StructType):
        return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def _walk(links: DataFrame) -> DataFrame:
    """Ranks of a list of bounded length, in one task."""
    schema = StructType([links.schema["id"], StructField("rank", LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        name = [tuple(x.values()) if isinstance(x, dict) else x for x in table["id"].to_pylist()]
        before = [tuple(x.values()) if isinstance(x, dict) else x for x in table["prev"].to_pylist()]
        row_of = {x: i for i, x in enumerate(name)}
        follow = {row_of[p]: i for i, p in enumerate(before) if p is not None}
        gaps, ranks = table["gap"].to_pylist(), [None] * len(name)
        at, rank = next((i for i, p in enumerate(before) if p is None), None), 0
        while at is not None:
            rank += gaps[at]
            ranks[at] = rank
            at = follow.get(at)
        if None in ranks or len(row_of) < len(name):
            raise ValueError("links that are not one list")
        yield from pa.table({"id": table["id"], "rank": pa.array(ranks, pa.int64())}).to_batches()

    return links.repartition(1).mapInArrow(walk, schema)
