"""Multi-party dialogues rendered once for every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Template (fixed): mark, name of other speakers, line break, text, end mark, line break.
SYSTEM, USER, ASSISTANT, END = "<|system|>", "<|user|>", "<|assistant|>", "<|end|>"
#: A rendering is given in parts of so many turn numbers, so no row holds an unbounded dialogue.
PART_TURNS = 128


def guarded(text: Column) -> Column:
    """Text in which no mark can be read: backslashes double, ``<|`` gets one in front."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\<|"))


def rotate_perspectives(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context: tuple[str, ...] = ("system",),
) -> DataFrame:
    """(conv, speaker, part, offset, text, mask): each dialogue as each of its speakers sees it.

    Turns stand by turn number, then role, then text.  The speaker's turns are rendered as
    assistant, turns of the roles in ``context`` as system, all others as user with their name.
    ``mask`` lists the places (start, end in code points of the part's text) that the speaker
    writes, text and end mark: where a model of this speaker is trained.  A dialogue comes in
    parts of PART_TURNS turn numbers; ``offset`` is where a part begins in the whole rendering,
    so the parts' texts joined in order are the rendering.

    A null role is the speaker ``unknown``, a null text is empty, a null turn comes first (part 0).
    Rows with a null conversation belong to no dialogue and are left out.  Repeated rows are
    repeated turns.  A dialogue of context roles only has no speaker and no rendering.  An empty
    table gives an empty result; other columns are ignored.
    """
    turns = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(F.floor(F.col(turn) / PART_TURNS), F.lit(0)).cast("long").alias("_part"),
    )
    speakers = turns.where(~F.col("_role").isin(list(context))).select("_conv", F.col("_role").alias("_speaker")).distinct()
    parts = turns.groupBy("_conv", "_part").agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text"))).alias("_turns"))
    empty = F.expr("named_struct('text', '', 'mask', cast(array() as array<struct<start:int,end:int>>))")

    def step(done, t):
        own = t["_role"] == F.col("_speaker")
        name = F.translate(guarded(t["_role"]), "\n\r", "  ")
        head = F.when(own, F.lit(f"{ASSISTANT}\n")).when(t["_role"].isin(list(context)), F.lit(f"{SYSTEM}\n")).otherwise(F.concat(F.lit(USER), name, F.lit("\n")))
        start = F.char_length(done["text"]) + F.char_length(head)
        body = F.concat(guarded(t["_text"]), F.lit(END))
        span = F.array(F.struct(start.alias("start"), (start + F.char_length(body)).alias("end")))
        return F.struct(
            F.concat(done["text"], head, body, F.lit("\n")).alias("text"),
            F.when(own, F.concat(done["mask"], span)).otherwise(done["mask"]).alias("mask"),
        )

    shown = parts.join(speakers, "_conv").withColumn("_shown", F.aggregate("_turns", empty, step))
    before = Window.partitionBy("_conv", "_speaker").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return shown.select(
        F.col("_conv").alias(conv), F.col("_speaker").alias("speaker"), F.col("_part").alias("part"),
        F.coalesce(F.sum(F.char_length("_shown.text")).over(before), F.lit(0)).cast("long").alias("offset"),
        F.col("_shown.text").alias("text"), F.col("_shown.mask").alias("mask"),
    )
