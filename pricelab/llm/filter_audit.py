r"""Filter interaction audit: what every order of a set of filters removes, by a recursive CTE.

1. ``mask_cells`` reduces the documents to counts per part and mask (one bit per failed filter): at most 32 rows a part.
   The filter on repeated texts needs other rows: texts are told apart by SHA-256, rows are combined per (id,
   text) and then per text before they are shuffled, so that a text which a third of all rows hold is one row a
   task, and the first holder is known without a join back to the documents.
2. ``enumerate_orders`` is the recursion. Its anchor holds the masks that occur; each level joins every prefix with
   the letters it doesn't have, carries the bits applied so far, and appends that step's outcome for the mask. Depth
   and width depend on the number of filters only (5 filters: 325 prefixes times at most 32 masks), never on the data.
3. ``audit`` weighs the outcomes with the cells' counts: the recursion's last level (bounded as above) is broadcast.

Rows: a null text is empty, a null part is the empty string, joined with parts that are empty. A document whose id is
null has no labels and fails no filter on smaller ids; nor does it make others fail. Rows that repeat an id count
each; equal ones don't fail the repeat filter by one another. Several labels of one id count once (any 1 counts).
Very long texts are one row each. An empty table has no part and gives no rows; labels may be empty. Extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD_GAP = r"[\x20\x09-\x0D]+"

#: Letters of the filters; the last is the filter on repeated texts.
LETTERS = "ABCDE"

#: Tasks over which rows without an id are spread in the join with the labels.
SPREAD = 64


def text_mask(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the bits of the filters A to D that its text fails."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = docs.withColumn("__words", F.array_remove(F.split(t, WORD_GAP), ""))
    n = F.size("__words")
    fails = [n < 200, 100 * F.size(F.array_distinct("__words")) < 50 * n,
             100 * F.regexp_count(t, F.lit("[A-Z]")) > 3 * F.length(t), t.rlike("[#$%&*|]")]
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return x.withColumn(out, mask).drop("__words")


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", repeat_bit: int = 1 << 4) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of ``docs`` (doc_id, text, part) per part and mask of failed filters."""
    x = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("__part"), "text")
    x = text_mask(x, "text", "__mask").select("doc_id", "__part", "__mask", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("__sha"))
    x = x.groupBy("doc_id", "__part", "__mask", "__sha").agg(F.count(F.lit(1)).alias("__n"))
    known = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("__good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("__toxic")))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("__sha"), F.lit(SPREAD))).otherwise(F.lit(0))
    x = x.withColumn("__spread", spread.cast("int")).join(known.withColumn("__spread", F.lit(0)), ["doc_id", "__spread"], "left")
    x = x.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("__good", "__toxic")})
    # per text: rows, rows without an id, the smallest id and its rows
    x = x.groupBy("__sha", "__part", "__mask", "__good", "__toxic").agg(
        F.sum("__n").alias("__n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("__n")).otherwise(0)).alias("__no_id"),
        F.min("doc_id").alias("__first"), F.min_by("__n", "doc_id").alias("__first_n"))
    x = x.withColumn("__least", F.min("__first").over(Window.partitionBy("__sha")))
    unrepeated = F.col("__no_id") + F.when(F.col("__first") == F.col("__least"), F.col("__first_n")).otherwise(0)
    cells = F.array(F.struct(F.col("__mask").alias("mask"), unrepeated.alias("n")),
                    F.struct(F.col("__mask").bitwiseOR(F.lit(repeat_bit)).alias("mask"), (F.col("__n") - unrepeated).alias("n")))
    x = x.select(F.col("__part").alias("part"), "__good", "__toxic", F.inline(cells)).where("n > 0")
    return x.groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.when(F.col("__good"), F.col("n")).otherwise(0)).alias("good"),
                                         F.sum(F.when(F.col("__toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def enumerate_orders(spark: SparkSession, masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(filter_order, step, letter, mask, kept, removed, redundant, unique_fails) for every permutation of ``letters``, step and
    mask of ``masks`` (column mask): whether a document of that mask is kept after, removed in, fails again or fails only here."""
    values = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))
    levels = spark.sql(f"""
        WITH RECURSIVE letters(letter, bit) AS (VALUES {values}),
        prefixes(filter_order, step, applied, mask, steps) AS (
          SELECT '', 0, 0, CAST(mask AS INT), CAST(array() AS ARRAY<STRUCT<step: INT, letter: STRING, kept: BOOLEAN, removed: BOOLEAN, redundant: BOOLEAN, unique_fails: BOOLEAN>>)
          FROM {{masks}}
          UNION ALL
          SELECT concat(p.filter_order, l.letter), p.step + 1, p.applied | l.bit, p.mask,
                 array_append(p.steps, named_struct('step', p.step + 1, 'letter', l.letter,
                   'kept', p.mask & (p.applied | l.bit) = 0, 'removed', p.mask & l.bit <> 0 AND p.mask & p.applied = 0,
                   'redundant', p.mask & l.bit <> 0 AND p.mask & p.applied <> 0, 'unique_fails', p.mask = l.bit))
          FROM prefixes p JOIN letters l ON p.applied & l.bit = 0
        )
        SELECT filter_order, mask, inline(steps) FROM prefixes WHERE step = {len(letters)}""", masks=masks)
    return levels.select("filter_order", "step", "letter", "mask", "kept", "removed", "redundant", "unique_fails")


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The metrics of every part, order and step from the cells of :func:`mask_cells`, zeros included."""
    orders = enumerate_orders(cells.sparkSession, cells.select("mask").distinct(), letters)
    x = cells.join(F.broadcast(orders), "mask")      # at most (letters)! * letters * 2^letters rows

    def total(flag: str, count: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(count)).otherwise(0)).cast("long")

    x = x.groupBy("part", "filter_order", "step", "letter").agg(
        total("kept", "docs").alias("kept"), total("removed", "docs").alias("removed"), total("redundant", "docs").alias("redundant"),
        total("unique_fails", "docs").alias("unique_fails"), total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"))
    # every (part, filter) stands once in each of the orders
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return x.withColumn("shapley", shapley).drop("letter")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole documents (see the module's text)."""
    cells = mask_cells(docs, labels).checkpoint(eager=True)    # 32 rows a part; read by the recursion and by the sums
    return audit(cells)


N_ORDERS = math.factorial(len(LETTERS))

ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT d.doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM m LEFT JOIN labels l ON l.doc_id = m.doc_id GROUP BY 1, 2
), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT '' AS filter_order, 0 AS applied
  UNION ALL SELECT o.filter_order || f.letter, o.applied | f.bit FROM o JOIN f ON o.applied & f.bit = 0
), s AS (
  SELECT a.filter_order, step::INTEGER AS step, f.letter, f.bit, b.applied
  FROM o a, range(1, 6) r(step) JOIN f ON f.letter = a.filter_order[r.step]
  JOIN o b ON b.filter_order = substr(a.filter_order, 1, r.step - 1) WHERE length(a.filter_order) = 5
), x AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & applied <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM x
"""
