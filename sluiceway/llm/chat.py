"""Dialogues rendered once from every participant's point of view.

All of it is DataFrame functions. For each participant the turns are written down with that
participant as the assistant and the others as named users, and a mask says which
characters the participant is trained on. A dialogue is written in segments of ``SEGMENT``
turns, so that no row grows with the length of a dialogue. Turns are counted over the whole
table, at any skew, so a dialogue may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.ordinals import with_ordinal

SEGMENT = 64
# The chat format.
SYSTEM, ASSISTANT, END = "<|system|>\n", "<|assistant|>\n", "<|end|>\n"
NOT_NAMES = r"[^A-Za-z0-9_.-]"


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns with their place in the dialogue, from 0; marks in a text are broken up."""
    rows = (
        turns.where(F.col(conv).isNotNull())
        .select(
            F.col(conv).alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
            F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        )
        # Tells equal turns apart, which are written alike in either order.
        .withColumn("row", F.monotonically_increasing_id())
    )
    numbered = with_ordinal(rows, ["turn", "role", "text", "row"], ["conv_id"], "place")
    return numbered.withColumn("place", F.col("place") - 1).drop("row")


def _written(turn: Column, speaker: Column) -> Column:
    """Head and body of a turn, and whether the speaker is trained on the body."""
    name = F.regexp_replace(turn["role"], NOT_NAMES, "_")
    user = F.concat(F.lit("<|user name="), name, F.lit("|>\n"))
    head = (
        F.when(turn["role"] == "system", F.lit(SYSTEM))
        .when(turn["role"] == speaker, F.lit(ASSISTANT))
        .otherwise(user)
    )
    return F.struct(
        head.alias("head"),
        F.concat(turn["text"], F.lit(END)).alias("body"),
        (turn["role"] == speaker).alias("own"),
    )


def rotations(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per dialogue, participant and segment.

    Columns: conv_id, speaker, segment (from 0), n_turns, text, mask (``start:end`` in code
    points of the segment's text, ends exclusive, comma-joined), n_masked. Every role but
    ``system`` is a participant; a dialogue without one has no rows. Turns go by number, those
    without one first, then by role and text; repeated ones are all kept. Segments after the
    one that has the dialogue's first system turn begin with that turn, which is not counted
    in their n_turns; a dialogue's segments in order, without these, are the whole rendering.
    A null role is ``unknown``, a null text empty; rows without a dialogue are left out.
    """
    rows = _turns(turns, conv, turn, role, text)
    segment = F.floor(F.col("place") / SEGMENT).cast("long")
    segments = rows.groupBy("conv_id", segment.alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    speakers = rows.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker"))
    system = rows.where("role = 'system'").groupBy("conv_id").agg(
        F.min(F.struct(segment.alias("segment"), "place", "text")).alias("system")
    )
    opening = F.when(
        F.col("system.segment") < F.col("segment"), F.concat(F.lit(SYSTEM), "system.text", F.lit(END))
    ).otherwise(F.lit(""))
    # One-row explodes, so that what they hold is worked out once and not in every use.
    written = (
        segments.join(speakers.distinct(), "conv_id")
        .join(system, "conv_id", "left")
        .select("conv_id", "speaker", "segment", opening.alias("opening"), "turns")
        .withColumn("w", F.explode(F.array(F.transform("turns", lambda t: _written(t, F.col("speaker"))))))
        .withColumn("own", F.explode(F.array(_own_spans())))
    )
    return written.select(
        "conv_id",
        "speaker",
        "segment",
        F.size("w").cast("long").alias("n_turns"),
        F.concat("opening", F.array_join(F.transform("w", lambda t: F.concat(t["head"], t["body"])), "")).alias("text"),
        F.array_join("own.spans", ",").alias("mask"),
        F.col("own.masked").alias("n_masked"),
    )


def _own_spans() -> Column:
    """Where the speaker's own turns are in a segment's text, in one pass over its turns."""

    def struct(at: Column, spans: Column, masked: Column) -> Column:
        return F.struct(at.alias("at"), spans.alias("spans"), masked.alias("masked"))

    def step(done: Column, turn: Column) -> Column:
        start = done["at"] + F.length(turn["head"])
        end = start + F.length(turn["body"])
        span = F.array(F.concat_ws(":", start, end))
        return struct(
            end,
            F.when(turn["own"], F.concat(done["spans"], span)).otherwise(done["spans"]),
            done["masked"] + F.when(turn["own"], end - start).otherwise(F.lit(0).cast("long")),
        )

    none = F.array().cast("array<string>")
    return F.aggregate("w", struct(F.length("opening").cast("long"), none, F.lit(0).cast("long")), step)
