"""Chart-ready summary tables.

Each output is bounded by its bucket / bin / grid count, never by the data:
the chart data is reduced on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.functions.calendar import day_name
from pricelab.operators.stats import quantiles_by_column
from pricelab.session import ensure_checkpoint_dir

# Kernel density defaults (grid points, cut in bandwidths) and
# how many bins of pre-aggregated values a bandwidth holds.
KDE_GRID_SIZE = 200
KDE_CUT = 3.0
KDE_BINS_PER_BANDWIDTH = 16
#: Groups up to which one statistics row per group is broadcast (a few MB).
SMALL_GROUPS = 50_000


def _per_group(stats: DataFrame) -> DataFrame:
    """Statistics rows (one per group), fixed once and broadcast after a check of their number, so the raw
    rows needn't be shuffled on what may be two values; beyond it Spark joins as it sees fit."""
    ensure_checkpoint_dir(stats.sparkSession)
    stats = stats.checkpoint()
    return F.broadcast(stats) if stats.count() <= SMALL_GROUPS else stats


def group_means(df: DataFrame, key: str, value: str, out: str = "avg_price") -> DataFrame:
    """Mean of ``value`` per ``key`` (A6/A7); partial aggregation map-side."""
    return df.groupBy(key).agg(F.avg(value).alias(out), F.count(value).alias("n"),
                               F.sum(value).alias("total"))


def monthly_profile(df: DataFrame, price_col: str, month_col: str = "month") -> DataFrame:
    return group_means(df, month_col, price_col)


def weekday_profile(df: DataFrame, price_col: str, dow_col: str = "day_of_week") -> DataFrame:
    g = group_means(df, dow_col, price_col)
    return g.withColumn("day_name", day_name(F.col(dow_col)))


def time_bucket(df: DataFrame, time_col: str, unit: str) -> Column:
    """``date_trunc`` that keeps a ``timestamp_ntz`` input zone-free (Spark's
    ``date_trunc`` returns a session-zone ``timestamp``)."""
    b = F.date_trunc(unit, F.col(time_col))
    if df.schema[time_col].dataType.simpleString() == "timestamp_ntz":
        b = b.cast("timestamp_ntz")
    return b


def price_series(df: DataFrame, time_col: str, price_col: str, unit: str = "month") -> DataFrame:
    """Down-sampled series (C1, T1): per ``date_trunc(unit)`` bucket the count,
    mean, min and max, ordered by bucket."""
    b = time_bucket(df, time_col, unit)
    return (df.where(F.col(time_col).isNotNull())
              .groupBy(b.alias("bucket_start"))
              .agg(F.count(price_col).alias("n"), F.avg(price_col).alias("avg_price"),
                   F.min(price_col).alias("min_price"), F.max(price_col).alias("max_price"),
                   F.sum(price_col).alias("total"))
              .orderBy("bucket_start"))


# ---------------------------------------------------------------- A13 histogram

def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Equal-width histogram of ``col``.

    Without ``bins`` the width is numpy's 'auto' rule: the smaller of the
    Freedman-Diaconis width (2 IQR n^-1/3) and Sturges' (range / (log2 n + 1));
    the bin count is ceil(range / width). Edges span [min, max]; the last bin
    is closed. Output: bin, bin_start, bin_end, count.
    """
    q = quantiles_by_column(df, [col], [0.25, 0.75])
    v = F.col(col).cast("double")
    mm = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    stats = q.crossJoin(mm)
    rng = F.col("hi") - F.col("lo")
    if bins is None:
        n = F.col("n").cast("double")
        fd = F.lit(2.0) * (F.col("q1") - F.col("q0")) * F.pow(n, F.lit(-1.0 / 3.0))
        sturges = rng / (F.log2(n) + F.lit(1.0))
        width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
        nb = F.when(rng > 0, F.ceil(rng / width)).otherwise(F.lit(1)).cast("long")
    else:
        nb = F.lit(int(bins)).cast("long")
    stats = stats.select("lo", "hi", nb.alias("nb"))
    stats = stats.withColumn("w", (F.col("hi") - F.col("lo")) / F.col("nb"))
    j = df.select(v.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x")).crossJoin(F.broadcast(stats))
    raw = F.when(F.col("w") > 0, F.floor((F.col("__x") - F.col("lo")) / F.col("w"))).otherwise(F.lit(0))
    b = F.least(raw.cast("long"), F.col("nb") - 1)
    counts = j.groupBy(b.alias("bin"), "lo", "w", "nb").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin",
                         (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"),
                         (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_end"),
                         "count")


# ---------------------------------------------------------------- A14 density

def kernel_density(df: DataFrame, value_col: str, group_col: str | None = None,
                   grid_size: int = KDE_GRID_SIZE, cut: float = KDE_CUT,
                   bins_per_bandwidth: int = KDE_BINS_PER_BANDWIDTH) -> DataFrame:
    """Gaussian kernel density per group on an evenly spaced grid.

    Bandwidth is Scott's rule: sample std * n^(-1/5); the grid runs from
    min - cut*bw to max + cut*bw. Values are first counted in bins of a fixed part
    of the bandwidth (only bins that hold values exist), so the density is that
    of the exact kernel to about (1 / bins_per_bandwidth)^2 / 24 of its curvature,
    whatever the range and the tails.
    Output: group, grid_i, x, density.
    """
    g = [F.col(group_col).alias("grp")] if group_col else [F.lit("all").alias("grp")]
    x = df.select(*g, F.col(value_col).cast("double").alias("__x")).where(
        F.col("__x").isNotNull() & ~F.isnan("__x"))
    st = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("lo"),
                              F.max("__x").alias("hi"), F.stddev_samp("__x").alias("sd"))
    st = st.withColumns({
        "bw": F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)),
    }).withColumn("bin_w", F.col("bw") / F.lit(float(bins_per_bandwidth)))
    st = _per_group(st)
    j = x.join(st.select("grp", "lo", "bin_w"), "grp")
    raw = F.when(F.col("bin_w") > 0, F.floor((F.col("__x") - F.col("lo")) / F.col("bin_w"))).otherwise(F.lit(0))
    binned = j.groupBy("grp", raw.cast("long").alias("b")) \
        .agg(F.count(F.lit(1)).alias("w"))
    centres = binned.join(st, "grp").select(
        "grp", "w", "n", "bw", "lo", "hi",
        (F.col("lo") + (F.col("b") + F.lit(0.5)) * F.col("bin_w")).alias("c"))
    gstart = F.col("lo") - F.lit(cut) * F.col("bw")
    gstep = (F.col("hi") - F.col("lo") + F.lit(2 * cut) * F.col("bw")) / F.lit(float(grid_size - 1))
    pts = centres.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid_size - 1).cast("long"))).alias("grid_i"))
    gx = gstart + F.col("grid_i") * gstep
    z = (gx - F.col("c")) / F.col("bw")
    kern = F.col("w") * F.exp(F.lit(-0.5) * z * z)
    dens = pts.groupBy("grp", "grid_i").agg(
        F.first(gx).alias("x"),
        (F.sum(kern) / (F.first("n") * F.first("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
    out = dens.withColumnRenamed("grp", group_col or "group")
    return out


# ---------------------------------------------------------------- C4, C6

def prediction_series(pred_long: DataFrame, time_col: str = "ts", unit: str = "month",
                      actual_from: str = "tree") -> DataFrame:
    """Actual and each model's prediction as (bucket_start, series, avg_value,
    n) -- the long form behind an actual-vs-predicted chart (C4). The actuals
    are those of the rows of one model, ``actual_from``."""
    actual = pred_long.where(F.col("model") == actual_from).select(
        time_col, F.lit("actual").alias("series"), F.col("actual").alias("value"))
    preds = pred_long.select(time_col, F.col("model").alias("series"), F.col("predicted").alias("value"))
    both = actual.unionByName(preds)
    return both.groupBy(time_bucket(both, time_col, unit).alias("bucket_start"), "series") \
        .agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def residual_bins(pred_long: DataFrame, bins: int = 50) -> DataFrame:
    """2-D counts of (predicted, residual) per model on a bins x bins grid
    spanning each model's ranges (C6)."""
    r = pred_long.select("model", F.col("predicted").alias("p"),
                         (F.col("actual") - F.col("predicted")).alias("e"))
    st = r.groupBy("model").agg(F.min("p").alias("p_lo"), F.max("p").alias("p_hi"),
                                F.min("e").alias("e_lo"), F.max("e").alias("e_hi"))
    j = r.join(_per_group(st), "model")

    def _bin(v: str, lo: str, hi: str) -> Column:
        w = (F.col(hi) - F.col(lo)) / F.lit(float(bins))
        raw = F.when(w > 0, F.floor((F.col(v) - F.col(lo)) / w)).otherwise(F.lit(0))
        return F.least(raw.cast("long"), F.lit(bins - 1))

    counts = j.groupBy("model", _bin("p", "p_lo", "p_hi").alias("pred_bin"),
                       _bin("e", "e_lo", "e_hi").alias("resid_bin"),
                       "p_lo", "p_hi", "e_lo", "e_hi").agg(F.count(F.lit(1)).alias("n"))

    def _centre(b: str, lo: str, hi: str) -> Column:
        return F.col(lo) + (F.col(b) + F.lit(0.5)) * ((F.col(hi) - F.col(lo)) / F.lit(float(bins)))

    return counts.select("model", "pred_bin", "resid_bin", "n",
                         _centre("pred_bin", "p_lo", "p_hi").alias("pred_centre"),
                         _centre("resid_bin", "e_lo", "e_hi").alias("resid_centre"))
