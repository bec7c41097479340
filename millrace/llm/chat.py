"""Chat formatting by rotating perspectives. DataFrame functions only.

A dialogue is rendered once for every participant: that speaker's turns are the
assistant's, all others are users under their names, and only the assistant's
turns count in the loss mask. System turns stay system turns in every rendering.
The result has a row per perspective and turn, with the turn's text and its place
in the rendering, so a dialogue of any length is never gathered in one task;
places are running sums within blocks of turns, on top of the sums of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed marks around a turn.
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
BLOCK = 1024


def unmarked(text: Column) -> Column:
    """Text in which nothing reads as a mark: <|im_ becomes < |im_, so no turn can forge another."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def rotate(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. One row for each participant (`perspective`) and turn of a conversation.

    Returns conv_id, perspective, turn, speaker, chat_role (system, assistant or user),
    rendered, mask (1: in the loss), content_start, content_end (code points of the
    text in the whole rendering), start, end (of the rendered turn). Speakers are
    roles other than the system's, with surrounding blanks cut off; a null role is
    the speaker `unknown`, a null text is empty, a null turn comes first, and equal
    turns stand in the order of role and text. Marks that texts and roles spell are
    broken up, and line ends in roles are blanks. A conversation of system turns only
    has no perspective and gives no rows. A null conv_id is a conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.trim(unmarked(F.translate(F.col("role").cast("string"), "\r\n", "  "))), F.lit("unknown")).alias("speaker"), unmarked(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    # A null conv_id is told by a flag, so that joins are on plain keys.
    rows = rows.withColumn("conv", F.coalesce("conv_id", F.lit(0))).withColumn("none", F.col("conv_id").isNull()).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    talk, where = ["conv", "none"], ["conv", "none", "block", "place"]
    turn = Window.partitionBy(*talk, "block").orderBy("turn", "speaker", "text")
    rows = rows.withColumn("place", F.row_number().over(turn))
    # Places come of lengths alone; texts are met again once they are known.
    own = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(START), F.col("chat_role"), F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    # Distinct speakers are found with partial sums, so a long dialogue costs its tasks only what they read.
    people = rows.select(*talk, "speaker").filter(F.col("speaker") != SYSTEM).select(*talk, F.col("speaker").alias("perspective")).distinct()
    met = rows.select(*where, "speaker", F.length("text").alias("chars")).join(people, talk).withColumn("chat_role", own).withColumn("head", F.length(head))
    met = met.select(*where, "perspective", "chat_role", "head", (F.col("head") + F.col("chars") + len(END)).cast("long").alias("size"))
    keys = [*talk, "perspective"]
    sums = met.groupBy(*keys, "block").agg(F.sum("size").alias("n"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*keys, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumn("upto", F.sum("size").over(inside)).join(bases, [*keys, "block"])
    out = placed.join(rows.select(*where, "conv_id", "turn", "speaker", "text"), where)
    start = F.col("base") + F.col("upto") - F.col("size")
    first = start + F.col("head")
    return out.select(
        "conv_id", "perspective", "turn", "speaker", "chat_role", F.concat(head, "text", F.lit(END)).alias("rendered"),
        F.when(F.col("chat_role") == "assistant", 1).otherwise(0).alias("mask"),
        first.alias("content_start"), (first + F.length("text")).alias("content_end"), start.alias("start"), (start + F.col("size")).alias("end"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """Whole renderings, for dialogues known to fit a row: conv_id, perspective, rendering, spans of the mask. A null conv_id is a conversation; no rows give none."""
    parts = F.sort_array(F.collect_list(F.struct("start", "end", "rendered", "mask", "content_start", "content_end")))
    whole = rotated.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    kept = F.transform(F.filter("parts", lambda p: p["mask"] == 1), lambda p: F.struct(p["content_start"].alias("start"), p["content_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendering"), kept.alias("mask"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, trim(replace(translate(role, chr(13) || chr(10), '  '), '<|im_', '< |im_')) AS speaker, replace(text, '<|im_', '< |im_') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
m AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role FROM t JOIN p USING (conv_id)),
h AS (SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM m),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM h),
s AS (SELECT *, (sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM r)
SELECT conv_id, perspective, turn, speaker, chat_role, rendered, CASE WHEN chat_role = 'assistant' THEN 1 ELSE 0 END AS mask,
  "end" - length(rendered) + length(head) AS content_start, "end" - length(rendered) + length(head) + length(text) AS content_end, "end" - length(rendered) AS start, "end"
FROM s"""
