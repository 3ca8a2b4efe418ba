"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation (each different role but `system`) gets a rendering of the whole dialogue in which it is the assistant, the
others are users with their names, and system messages stay system messages. A rendering is rows, one a message, with the
message's place in the rendered text; the mask is 1 on what the perspective's own speaker says (and the end mark), 0 elsewhere.

A conversation of any length is never gathered: its turns are dealt to spans, and texts are moved once, to their span. Renderings of one dialogue differ only in the
heads of the speaker's own messages, so a message's place is the size of all before it, as rendered for anyone else, plus the difference
of the two heads times the speaker's messages before it; both are sums inside the span on top of sums over the spans before, which are narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"


def _named(role: Column) -> Column:
    """The head of a message as others see it."""
    return F.when(role == "system", F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), role, F.lit("\n")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = 1024) -> DataFrame:
    """(conv_id, perspective, turn, head, body, start, body_start, end, mask), a row per perspective and message.

    The rendering is head + body of the rows of a (conv_id, perspective) by start. head opens the message, body is the text and END;
    start, body_start and end are code points in the whole rendering. Messages go by turn, then role, then text; equal rows stay, each
    in its own place. Null texts are empty, a null role is the participant `unknown`, null turns come first; rows with a null conv_id are one conversation.
    A conversation of system messages alone has no perspective and no rows; an empty table gives an empty one. Texts of any length are rendered whole. Only the four named columns are
    read, so others may have any name.
    """
    conv, turn = F.col(conv_col), F.col(turn_col)
    own_head = len(f"{START}assistant\n")
    role = F.coalesce(F.col(role_col), F.lit("unknown"))
    # keys that are never null, so that joins on them and windows over them ask for one and the same partitioning
    keys = [conv.isNull().alias("void"), F.coalesce(conv.cast("string"), F.lit("")).alias("key"), F.floor(F.coalesce(turn, F.lit(-1)) / span).alias("part")]
    at = ["void", "key", "part"]
    size = (F.length(_named(F.col("role"))) + F.length("text") + len(END)).cast("long")
    said = turns.select(*keys, conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("size", size)

    # narrow: what each speaker says in a span, and from it what all say before the span
    spoken = said.groupBy(*at, "role").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    parts = spoken.groupBy(*at).agg(F.sum("size").alias("size"))
    speakers = spoken.where("role <> 'system'").select("void", "key", F.col("role").alias("perspective")).distinct()
    own = spoken.select(*at, F.col("role").alias("perspective"), "n")
    before = Window.partitionBy("void", "key", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.join(speakers, ["void", "key"]).join(own, [*at, "perspective"], "left")
    longer = own_head - F.length(_named(F.col("perspective")))
    bases = bases.select(*at, "perspective", (F.coalesce(F.sum("size").over(before), F.lit(0)) + longer * F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))

    inside = Window.partitionBy(*at).orderBy("turn", "role", "text")
    placed = said.withColumn("nth", F.row_number().over(inside)).withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = placed.join(bases, at).withColumn("mask", (F.col("role") == F.col("perspective")).cast("int"))
    mine = F.coalesce(F.sum("mask").over(Window.partitionBy(*at, "perspective").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.when(F.col("mask") == 1, F.lit(f"{START}assistant\n")).otherwise(_named(F.col("role")))
    rows = rows.withColumn("start", (F.col("base") + F.col("before") + longer * mine).cast("long")).withColumn("head", head).withColumn("body", F.concat("text", F.lit(END)))
    body_start = F.col("start") + F.length("head")
    return rows.select("conv_id", "perspective", "turn", "head", "body", "start", body_start.alias("body_start"), (body_start + F.length("body")).alias("end"), "mask")


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), r AS (
  SELECT t.conv_id, perspective, turn, role, text, CAST(role = perspective AS INTEGER) AS mask,
         CASE WHEN role = 'system' THEN '<|im_start|>system' WHEN role = perspective THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r
)
SELECT conv_id, perspective, turn, head, body, CAST(before AS BIGINT) AS "start", CAST(before + length(head) AS BIGINT) AS body_start,
       CAST(before + length(head) + length(body) AS BIGINT) AS "end", mask FROM p
"""
