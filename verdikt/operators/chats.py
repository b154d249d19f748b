"""Whole conversations as training text, in segments of bounded bytes.

A conversation of any length is rendered without one task holding it. Turns are
dealt by ranges of (conversation, place); a range sums the bytes of its own
turns, and the sums of a conversation's earlier ranges, a row per range, tell
where in the conversation each turn begins. That place gives the turn's segment,
and only the turns of one segment meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.session import materialize

#: Bytes of a segment; its last turn may go beyond.
SEGMENT = 1 << 20


def rendered_turn(role: Column, text: Column) -> Column:
    """One message under its role."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("</s>\n"))


def chat_segments(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, text, n_turns, n_user, n_open`` of every turn.

    Segments are numbered from 0 by the bytes before their first turn; joined in
    their order they are the whole conversation. ``n_open`` counts user turns
    that no assistant's turn follows. Turns of one number are ordered by role,
    then by the digest of their texts; repeated rows all stay. A missing number
    comes first, a missing role is empty, a missing text too.
    """
    who = F.coalesce(F.col(role), F.lit(""))
    tie = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), tie.alias("tie"), rendered_turn(who, F.col(text)).alias("piece")
    )
    order = ["turn", "role", "tie"]
    dealt = rows.repartitionByRange("conv_id", *order)
    dealt = materialize(dealt.withColumns({"range": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))

    own = dealt.select("conv_id", "range", "row", *order, F.octet_length("piece").cast("long").alias("bytes"))
    here = Window.partitionBy("conv_id", "range").orderBy(*order, "row")
    passed = F.sum("bytes").over(here.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumns({"passed": F.coalesce(passed, F.lit(0)), "next": F.lead("role").over(here)})

    ranges = own.groupBy("conv_id", "range").agg(F.sum("bytes").alias("bytes"), F.min_by("role", F.struct(*order, "row")).alias("first"))
    along = Window.partitionBy("conv_id").orderBy("range")
    before = F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(
        F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), F.coalesce(before, F.lit(0)).alias("before"), F.lead("first").over(along).alias("then")
    )
    met = own.join(ranges, own["conv_id"].eqNullSafe(ranges["_conv"]) & (own["range"] == ranges["_range"]))
    follows = F.coalesce("next", "then", F.lit(""))
    placed = met.select(
        "row",
        F.floor((F.col("before") + F.col("passed")) / size).alias("segment"),
        ((F.col("role") == "user") & (follows != "assistant")).alias("open"),
    )
    pieces = F.array_sort(F.collect_list(F.struct(*order, "row", "piece")))
    return (
        dealt.join(placed, "row")
        .groupBy("conv_id", "segment")
        .agg(
            F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"),
            F.count(F.lit(1)).alias("n_turns"),
            F.count_if(F.col("role") == "user").alias("n_user"),
            F.count_if(F.col("open")).alias("n_open"),
        )
    )
