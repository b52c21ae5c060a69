r"""Exact dedup by content-defined chunk recipes (DataFrame operations only).

Texts are equal if they are identical without the white space ``[\x20\x09-\x0D]``. Each normalised text is cut where
its own bytes say so: after ``WINDOW`` bytes in a row that each fall into that place's pseudo-random half of the byte
values (about one place in 2^WINDOW), in chunks of at least ``MIN_CHUNK`` and at most ``MAX_CHUNK`` bytes. An edit
or a copied passage therefore moves only the cuts near it, and texts share the chunks of what they share.

1. One pass normalises, hashes and cuts every text and writes its chunks, their 64-bit numbers and the row's key
   columns to the shared folder. Row numbers are fixed there.
2. Chunks are deduplicated: equal ones meet in a task's partial aggregate first, so every distinct chunk is moved once
   a task and copies of a document move nothing more. The whole chunk is the key, so a number that stands for two
   different chunks is found; such chunks get the number and an ordinal, all others the number alone. Both
   are verified identifiers: the same one for the same bytes, different ones for different bytes.
3. Documents are compared by their ordered identifier lists (8 bytes for about a kilobyte of text); the texts
   themselves don't move again. A group of copies is pre-aggregated per task to its size and the row that stays; the
   answer returns to its rows by a join on the list, which adaptive execution splits where a group is large.

Rows: a null text is empty; all texts without a character other than white space are equal (the empty list). The
row with the most code points in its original text stays, then the smallest id; a null id counts as the
largest. Of rows that repeat id and text one stays (the first by row number). Very long texts are rows with
longer lists. An empty table gives no rows; extra columns of any name are ignored (``keep_one`` returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelab.session import ensure_checkpoint_dir, scratch_path

SPACE = " \t\n\x0b\f\r"
WINDOW = 10
MIN_CHUNK = 256
MAX_CHUNK = 4096

#: Bits of a chunk's number; fewer make the ordinals of colliding numbers testable.
NUMBER_BITS = 64

_ROW = "__dd_row"


def _cut_pattern() -> str:
    """Java pattern of one chunk over a text whose characters stand for bytes."""
    def half(place: int) -> str:
        own = [b for b in range(256) if ((b * 2654435761 + (place + 1) * 2246822519) >> 13) & 1]
        return "[" + "".join(f"\\x{b:02X}" for b in own) + "]"

    window = "".join(half(i) for i in range(WINDOW))
    return r"(?s).{%d,%d}?%s|.{1,%d}" % (MIN_CHUNK - WINDOW, MAX_CHUNK - WINDOW, window, MAX_CHUNK)


CUT = _cut_pattern()


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks(normal: Column) -> Column:
    """The chunks of a normalised text, as an array of binaries that concatenate to its UTF-8 bytes."""
    as_bytes = F.decode(F.encode(normal, "utf-8"), "iso-8859-1")
    return F.transform(F.regexp_extract_all(as_bytes, F.lit(CUT), F.lit(0)), lambda c: F.encode(c, "iso-8859-1"))


def _number(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits >= 64 else F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def cut_texts(docs: DataFrame, text: str, columns: dict[str, Column], bits: int = NUMBER_BITS) -> DataFrame:
    """``columns`` of every document with its row number, ``__n_chars``, ``__sha``, ``__chunks`` and ``__numbers``, written once."""
    path = scratch_path(docs.sparkSession, "recipes")
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], F.monotonically_increasing_id().alias(_ROW),
                       F.coalesce(F.length(text), F.lit(0)).cast("long").alias("__n_chars"), normalised(F.col(text)).alias("__normal"))
    rows = rows.withColumns({"__sha": F.sha2(F.encode("__normal", "utf-8"), 256), "__chunks": chunks(F.col("__normal"))}).drop("__normal")
    rows.withColumn("__numbers", F.transform("__chunks", lambda c: _number(c, bits))).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def ambiguous_numbers(cut: DataFrame, bits: int = NUMBER_BITS) -> DataFrame:
    """The numbers that stand for more than one chunk (``number``)."""
    distinct = cut.select(F.explode("__chunks").alias("chunk")).distinct()
    return distinct.groupBy(_number(F.col("chunk"), bits).alias("number")).count().where("count > 1").select("number")


def identifier_lists(cut: DataFrame, bits: int = NUMBER_BITS) -> DataFrame:
    """``cut`` without its chunks but with ``__ordinals``: the (place, ordinal) pairs of chunks whose number is ambiguous
    and whose ordinal isn't 0. ``__numbers`` and ``__ordinals`` together are the ordered list of verified identifiers."""
    none = F.array().cast("array<struct<place:int,ordinal:int>>")
    plain = cut.drop("__chunks")
    ensure_checkpoint_dir(cut.sparkSession)
    several = ambiguous_numbers(cut, bits).checkpoint(eager=True)
    if several.isEmpty():
        return plain.withColumn("__ordinals", none)
    held = (cut.select(_ROW, F.posexplode(F.arrays_zip("__numbers", "__chunks")).alias("place", "__pair"))
            .select(_ROW, "place", F.col("__pair.__numbers").alias("number"), F.col("__pair.__chunks").alias("chunk"))
            .join(several, "number", "left_semi"))
    contents = held.select("number", "chunk").distinct()
    ordinals = contents.withColumn("ordinal", F.row_number().over(Window.partitionBy("number").orderBy("chunk")) - 1)
    found = (held.join(ordinals.where("ordinal > 0"), ["number", "chunk"])
             .groupBy(_ROW).agg(F.array_sort(F.collect_list(F.struct("place", "ordinal"))).alias("__ordinals")))
    return plain.join(found, _ROW, "left").withColumn("__ordinals", F.coalesce("__ordinals", none))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = NUMBER_BITS,
           columns: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: its id, ``keep_id`` (the id of the row that stays), ``group_size``, ``kept``, ``text_sha256`` (of the
    normalised text); then the ``columns`` asked for."""
    extra = columns or {}
    lists = identifier_lists(cut_texts(docs, text, {"__id": F.col(f"`{id_col}`"), **extra}, bits), bits)
    key = ["__numbers", "__ordinals"]
    stays = F.struct((-F.col("__n_chars")).alias("short"), F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col(_ROW).alias("row"))
    found = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("__size"), F.min(stays).alias("__best")).where("__size > 1")
    out = lists.join(found, key, "left")
    alone = F.col("__size").isNull()
    return out.select(F.col("__id").alias(id_col), F.when(alone, F.col("__id")).otherwise(F.col("__best.id")).alias("keep_id"),
                      F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("__best.row") == F.col(_ROW))).alias("kept"), F.col("__sha").alias("text_sha256"), *extra)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; row numbers and column names of ``docs`` are not touched."""
    inner = {f"__in{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    kept = groups(docs, id_col, text, columns=inner).where("kept")
    return kept.select(*[F.col(f"__in{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
