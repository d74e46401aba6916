"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that
speaker as ``assistant`` and all others as named users. The result is long: a
row for each message of each rendering, with its text, its place in the whole
rendering, and the span that is trained on. So a conversation of any length
needs no row or task that holds it all; joined in order of ``position`` the
rows give the rendering, and ``start`` tells each one's first character in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BLOCK = 64


def rotate_perspectives(messages: DataFrame, context_roles: tuple[str, ...] = ("system",), conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, participant, position, turn, speaker, rendered, start, mask_start, mask_end).

    Speakers are the values of ``role``. Those in ``context_roles`` set the
    scene: they keep their role, are never trained on, and get no rendering of
    their own. ``mask_start`` and ``mask_end`` bound the trained characters of
    the whole rendering, content and end marker of the participant's messages;
    they are null elsewhere.

    Messages are ordered by turn (null last), then role, then text, so ties
    have a fixed order; repeated rows are one message. A null text is empty, a
    null role is the speaker ``unknown``, rows with a null conversation form
    one. A conversation that only has context roles has no rendering. Columns
    other than the four play no part, whatever their names.

    Scale: places are prefix sums in two levels (blocks of 64 turns, or of equal
    speakers and beginnings where there is no turn, then inside a block), so a
    conversation with a third of all rows is spread over tasks; the join of
    messages and participants can be split when skewed.
    """
    said = messages.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    ).distinct()
    people = said.filter(~F.col("speaker").isin(*context_roles)).select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("participant")).distinct()
    own = F.col("speaker") == F.col("participant")
    # messages without a turn come last, in blocks of those that begin alike
    lone = F.col("turn").isNull()
    block = F.struct(F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 63) - 1)).alias("turns"), F.when(lone, F.col("speaker")).otherwise("").alias("by"), F.when(lone, F.substring("content", 1, 8)).otherwise("").alias("start"))
    context = F.col("speaker").isin(*context_roles)
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(context, F.concat(F.lit(OPEN), "speaker", F.lit("\n"))).otherwise(F.concat(F.lit(f"{OPEN}user name="), "speaker", F.lit("\n")))
    shown = (
        said.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv")))
        .withColumn("head", F.length(head))
        .withColumn("rendered", F.concat(head, "content", F.lit(f"{CLOSE}\n")))
        .withColumn("size", F.length("rendered").cast("long"))
        .withColumn("block", block)
    )
    keys = ["conv_id", "participant"]
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shown.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.sum("size").alias("sum"))
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("participant").alias("b_participant"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b_n"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("b_start"),
    )
    inside = Window.partitionBy(*keys, "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "content")
    placed = shown.withColumn("i", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = reduce(lambda a, b: a & b, [F.col("conv_id").eqNullSafe(F.col("b_conv")), F.col("participant") == F.col("b_participant"), F.col("block") == F.col("b_block")])
    start = F.col("b_start") + F.col("upto") - F.col("size")
    return placed.join(blocks, same).select(
        "conv_id",
        "participant",
        (F.col("b_n") + F.col("i") - 1).alias("position"),
        "turn",
        "speaker",
        "rendered",
        start.alias("start"),
        F.when(own, start + F.col("head")).alias("mask_start"),
        F.when(own, start + F.col("size") - 1).alias("mask_end"),
    )
