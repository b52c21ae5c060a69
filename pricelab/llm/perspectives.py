"""Multi-party perspective rotation of conversations.

For every participant of a conversation the whole dialogue is rendered once, with that participant's turns
as the assistant's and everyone else's as those of named users. A turn becomes one segment:

    <|im_start|>assistant\\n{text}<|im_end|>\\n            (the participant's own)
    <|im_start|>user name={speaker}\\n{text}<|im_end|>\\n  (anyone else's)

The loss mask of a rendering covers the text and the end marker of each assistant turn, as character
offsets (code points) into the rendering. A rendering is cut into parts at turn borders: a turn belongs to part
``start // part_chars``, so a conversation of any length is never gathered whole; most are one part.

Order: by turn (null first), then speaker, then text. Offsets come from two levels of running sums: over
blocks of ``BLOCK`` turn numbers, then inside a block.

Rows: a null role is a speaker named ``unknown``, a null text is empty, rows with a null conv_id form one
conversation without an id. Repeated rows are repeated turns. Extra columns are ignored; an empty table gives
an empty result. Built from DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 256
PART_CHARS = 32768
UNKNOWN = "unknown"

_CONV = ["none", "conv"]


def segments(conversations: DataFrame) -> DataFrame:
    """One row per (conversation, perspective, turn) with the rendered segment and its offsets."""
    turns = conversations.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    people = turns.select(*_CONV, F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), "speaker", F.lit("\n")))
    body = F.concat("text", F.lit("<|im_end|>\n"))
    rows = (turns.join(people, _CONV)
            .withColumn("own", own).withColumn("head_chars", F.char_length(head).cast("long"))
            .withColumn("segment", F.concat(head, body)).withColumn("chars", F.char_length("segment").cast("long"))
            .withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 40))) / BLOCK)))
    side = [*_CONV, "perspective"]
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy(*side, "block").agg(F.sum("chars").alias("block_chars"), F.count("*").alias("block_turns"))
              .withColumn("chars_before", F.coalesce(F.sum("block_chars").over(before.partitionBy(*side).orderBy("block")), F.lit(0)))
              .withColumn("turns_before", F.coalesce(F.sum("block_turns").over(before.partitionBy(*side).orderBy("block")), F.lit(0)))
              .drop("block_chars", "block_turns"))
    inside = Window.partitionBy(*side, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    start = F.coalesce(F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("chars_before")
    return (rows.join(blocks, [*side, "block"])
            .withColumn("start", start).withColumn("seq", F.row_number().over(inside) + F.col("turns_before"))
            .select(*side, "seq", "turn", "speaker", "own", "segment", "start",
                    (F.col("start") + F.col("head_chars")).alias("text_start"),
                    # the mask ends after the end marker, before the line end
                    (F.col("start") + F.col("chars") - 1).alias("text_end")))


def rotate(conversations: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, perspective, part, first_turn, n_turns, n_own, start, rendered, masks of every part of every rendering.

    ``masks``: "a-b" character offsets (b exclusive, counted from the rendering's start), joined by commas."""
    rows = segments(conversations).withColumn("part", F.floor(F.col("start") / part_chars))
    span = F.concat(F.col("text_start").cast("string"), F.lit("-"), F.col("text_end").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("seq", "segment")))
    masks = F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("seq", span.alias("span")))))
    return (rows.groupBy(*_CONV, "perspective", "part")
            .agg(F.min("seq").alias("first_turn"), F.count("*").alias("n_turns"),
                 F.sum(F.col("own").cast("long")).alias("n_own"), F.min("start").alias("start"),
                 F.array_join(F.transform(listed, lambda x: x["segment"]), "").alias("rendered"),
                 F.array_join(F.transform(masks, lambda x: x["span"]), ",").alias("masks"))
            .select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "perspective", "part",
                    "first_turn", "n_turns", "n_own", "start", "rendered", "masks"))


#: DuckDB's form of the query.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns
), rows_ AS (
  SELECT t.conv_id, perspective, turn, speaker, text, speaker = perspective AS own,
         CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment,
         row_number() OVER w AS seq,
         coalesce(sum(length(head || text || '<|im_end|>' || chr(10)))
                  OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_
  FROM rows_ WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, perspective, (start_ // {PART_CHARS})::BIGINT AS part, min(seq)::BIGINT AS first_turn,
       count(*)::BIGINT AS n_turns, sum(own::INT)::BIGINT AS n_own, min(start_)::BIGINT AS start,
       string_agg(segment, '' ORDER BY seq) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (start_ + length(head))::VARCHAR || '-' ||
                           (start_ + length(segment) - 1)::VARCHAR END, ',' ORDER BY seq), '') AS masks
FROM placed GROUP BY conv_id, perspective, part
"""
