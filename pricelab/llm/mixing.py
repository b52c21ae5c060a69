"""Mixing sources to target weights by subset-sum budget fitting.

1. Every document's exact length in words is counted (null text: 0); documents are counted by source and
   length. From here on the work is on that histogram, whose size is bounded by the number of sources
   times the number of distinct lengths.
2. Targets: the sources, by code point with null last, take the weights in turn and share
   ``budget`` times all words by weight. A target stops at ``max_epochs`` times its source's words; what is
   above is shared again by weight until none is above.
3. A source's whole part of target / words is that many full copies of the source. The remaining budget
   is fitted by length: every length gets its proportional count, rounded down; what is still left is a
   bounded-knapsack problem over the documents left of each length, solved by dynamic programming over the
   reachable sums in a window that grows until no choice of documents comes closer (``fit_counts``), so the
   source's sum is as close under its target as its lengths allow.
4. The chosen number of documents of each (source, length) are those with the smallest seeded hashes of
   (doc_id, text). The cut is found through hash ranges of about ``RANGE_ROWS`` rows, so that a (source,
   length) that holds a third of all rows is never sorted in one task.

The choice depends on the rows and the seed alone: reruns agree. Rows that are equal in doc_id and text are
interchangeable; a tie between them is cut by their position. An empty table gives an empty result, a source
without words a target of 0. Documents without words are taken 0 words (and kept once per copy by
``mix_documents``). Other columns pass through ``mix_documents`` unless they start with ``__mix_``.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelab.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 256
#: Words that the dynamic programme of a source starts with.
WINDOW = 1 << 16
#: Its largest table of sums (five bytes each), for sources of a few very long lengths that fit no sum well.
MOST_SUMS = 1 << 25
KEY = ["__mix_none", "__mix_source"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _measured(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    """The rows of ``docs`` with source key, size, seeded hash and position."""
    body = F.col(text).cast("string")
    return (docs.withColumn("__mix_none", F.col(source).isNull())
            .withColumn("__mix_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
            .withColumn("__mix_size", word_count(body))
            .withColumn("__mix_hash", F.xxhash64(F.col(doc_id), body, F.lit(seed)).bitwiseAND((1 << 62) - 1))
            .withColumn("__mix_row", F.monotonically_increasing_id()))


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: int) -> DataFrame:
    """Source rows (key columns, source_size) -> with their target. One row per source, so the two windows
    over all sources are small."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(Window.orderBy(*KEY)) - 1, F.lit(len(weights))) + 1
    rows = (sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int")))
            .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
            .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
            .withColumn("ratio", F.col("cap") / F.col("w")))
    up = Window.orderBy("ratio", *KEY).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", *KEY).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # with all sources of a smaller ratio at their cap, the others stand at this multiple of their weight
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(down))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", *KEY, "level"))).over(everything)["level"]
    return rows.withColumn("first", first).select(
        *KEY, "source_size", F.coalesce(F.least("cap", F.col("first") * F.col("w")), F.col("cap")).alias("target"))


def _knapsack(lengths: list[int], free: list[int], order: list[int], goal: int) -> tuple[int, list[int]]:
    """The largest sum up to ``goal`` that ``free`` documents of each length reach, and how many of each it takes.

    Counts are split into powers of two; ``first`` holds the part that reached a sum first, so a sum's parts are
    found by walking down, and memory is a few bytes a word of ``goal``, however many parts there are."""
    first = np.full(goal + 1, -1, np.int32)
    first[0] = 0
    parts = [(0, 0)]
    for i in order:
        left, part = min(free[i], goal // lengths[i]), 1
        while left > 0 and first[goal] < 0:
            n = min(part, left)
            parts.append((i, n))
            w = lengths[i] * n
            fresh = (first[w:] < 0) & (first[: goal + 1 - w] >= 0)
            first[w:][fresh] = len(parts) - 1
            left -= n
            part *= 2
        if first[goal] >= 0:
            break
    best = at = int(np.flatnonzero(first >= 0)[-1])
    take = [0] * len(lengths)
    while at:
        i, n = parts[first[at]]
        take[i] += n
        at -= n * lengths[i]
    return best, take


def fit_counts(lengths: list[int], counts: list[int], rest: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take, so that their words come to ``rest`` or as little under it as any
    choice does.

    Every length gets its proportional count, rounded down. What is left above ``window`` words goes to single documents
    of the lengths that lost most by the rounding, the last ``window`` words to the dynamic programme. If that misses
    the best sum that the lengths' common divisor allows, the window doubles; once it holds all that is left, 1, 2, 4, ...
    documents of each length are given back to it. No best sum needs more given back than twice the largest length (over
    the common divisor): of more changes, some would cancel out. So the result is exact wherever its last table has at
    most ``MOST_SUMS`` sums, that is but for sources of a few lengths around 10,000 words and more that reach no sum
    near enough; those keep the best sum found so far. In nearly every case the first window is enough.
    """
    use = [i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0]
    total = sum(lengths[i] * counts[i] for i in use)
    none = [0] * len(lengths)
    if rest <= 0 or total <= 0:
        return none
    if rest >= total:
        return [c if size > 0 else 0 for size, c in zip(lengths, counts)]
    share = [counts[i] * rest // total if lengths[i] > 0 else 0 for i in range(len(lengths))]
    # lengths whose proportional count lost most by rounding come first; equal losses by length
    order = sorted(use, key=lambda i: (-Fraction(counts[i] * rest % total, total), lengths[i]))
    divisor = math.gcd(*(lengths[i] for i in use))
    goal, most = rest - rest % divisor, 2 * max(lengths[i] for i in use) // divisor
    best_sum, best, back = -1, none, 0
    while True:
        take = [max(0, n - back) for n in share]
        left = goal - sum(a * b for a, b in zip(lengths, take))
        whole = left <= window
        for i in order:
            if left > window and lengths[i] <= left and counts[i] > take[i]:
                take[i] += 1
                left -= lengths[i]
        free = [c - n if size > 0 else 0 for size, c, n in zip(lengths, counts, take)]
        if best != none and left // divisor >= MOST_SUMS:
            return best
        units = [size // divisor for size in lengths]
        reached, more = _knapsack(units, free, order, left // divisor)
        if goal - left + reached * divisor > best_sum:
            best_sum, best = goal - left + reached * divisor, [a + b for a, b in zip(take, more)]
        if best_sum == goal or (whole and (back >= most or not any(share[i] > back for i in use))):
            return best
        if whole:
            back = max(1, 2 * back)
        window *= 2


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("__mix_size")
    size, goal = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    copies = math.floor(goal / size + 1e-12) if size else 0
    rest = max(0, round(goal - copies * size))
    out = rows.copy()
    out["copies"] = copies
    out["take"] = fit_counts([int(x) for x in rows["__mix_size"]], [int(x) for x in rows["n"]], rest)
    return out


def plan(measured: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: int) -> DataFrame:
    """(source key, size) -> source_size, target, copies and the cut (hash, position) of the extra documents."""
    ensure_checkpoint_dir(measured.sparkSession)
    length = [*KEY, "__mix_size"]
    histogram = measured.groupBy(*length).agg(F.count("*").alias("n"))
    sizes = histogram.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("__mix_size")).alias("source_size"))
    rows = histogram.join(targets(sizes, weights, budget, max_epochs), KEY)
    fitted = rows.groupBy(*KEY).applyInPandas(_fit, (
        "__mix_none boolean, __mix_source string, __mix_size long, n long, source_size long, target double, copies int, take long")).checkpoint()
    ranges = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / RANGE_ROWS))).cast("int")
    some = fitted.filter("take > 0").select(*length, "take", ranges.alias("bits"))
    own = (measured.select(*length, "__mix_hash", "__mix_row").join(some, length)
           .withColumn("range", F.expr("shiftright(__mix_hash, 62 - bits)")))
    w = Window.partitionBy(*length).orderBy("range")
    cut_range = (own.groupBy(*length, "take", "range").agg(F.count("*").alias("m"))
                 .withColumn("upto", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                 .filter("upto >= take and upto - m < take")
                 .select(*length, "range", (F.col("take") - F.col("upto") + F.col("m")).alias("need")))
    ranked = (own.join(cut_range, [*length, "range"])
              .withColumn("rank", F.row_number().over(Window.partitionBy(*length, "range").orderBy("__mix_hash", "__mix_row"))))
    cut = ranked.filter("rank = need").select(*length, F.col("__mix_hash").alias("cut_hash"), F.col("__mix_row").alias("cut_row"))
    return fitted.join(cut, length, "left").select(*length, "source_size", "target", "copies", "cut_hash", "cut_row")


def _times(prefix: str = "") -> Column:
    """How often the plan takes a row."""
    cut_hash, cut_row = F.col(f"{prefix}cut_hash"), F.col(f"{prefix}cut_row")
    extra = (F.col("__mix_hash") < cut_hash) | ((F.col("__mix_hash") == cut_hash) & (F.col("__mix_row") <= cut_row))
    return F.col(f"{prefix}copies") + F.coalesce(extra.cast("int"), F.lit(0))


def mix_table(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2,
              text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted) and times of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    measured = (_measured(docs.select(doc_id, text, source), text, source, doc_id, seed)
                .select(doc_id, *KEY, "__mix_size", "__mix_hash", "__mix_row").checkpoint())
    joined = measured.join(plan(measured, weights, budget, max_epochs), [*KEY, "__mix_size"])
    return (joined.withColumn("times", _times())
            .select(doc_id, F.col("__mix_size").alias("size"), "source_size", "target",
                    (F.col("__mix_size") * F.col("times")).alias("taken"), "times"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2,
                  text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 11) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it."""
    ensure_checkpoint_dir(docs.sparkSession)
    measured = _measured(docs, text, source, doc_id, seed)
    lean = measured.select(*KEY, "__mix_size", "__mix_hash", "__mix_row").checkpoint()
    chosen = plan(lean, weights, budget, max_epochs)
    names = {c: f"__mix_{c}" for c in ("copies", "source_size", "target", "cut_hash", "cut_row")}
    joined = measured.join(chosen.withColumnsRenamed(names), [*KEY, "__mix_size"])
    return (joined.withColumn("__mix_times", _times("__mix_")).filter("__mix_times > 0")
            .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).select(*docs.columns))
