"""Whole-table statistics and the operators built on them.

Profiles (A1), exact quantiles / medians (A2, A4), modes (A3), imputation
(P5, P6), the IQR filter and its report (F1, A5) and the population
standard scaler (A10, P12).

Every statistic is a small frame (one row per column at most) that is joined
back with ``broadcast`` -- its size is bounded by the number of columns, not
by the data. Nothing is collected to literals except quantile bucket
boundaries, whose count is a fixed parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelab.functions.names import numeric_columns, string_columns
from pricelab.session import ensure_checkpoint_dir, small_frame

DEFAULT_QUANTILE_BUCKETS = 64
#: Distinct values of a range that is sorted by one task.
RANGE_VALUES = 1 << 18


# --------------------------------------------------------------------------
# A1: missing-value profile
# --------------------------------------------------------------------------

def null_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column_name, dtype, null_count, n_rows), one aggregation pass.

    NaN in floating columns counts as missing, as in pandas.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        missing = c.isNull()
        if f.dataType.typeName() in ("double", "float"):
            missing = missing | F.isnan(c)
        aggs.append(F.count_if(missing).alias(f"_m{i}"))
    counts = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f"_m{i}").alias("null_count"))
        for i, f in enumerate(fields)])
    out = counts.select(F.col("_n").alias("n_rows"), F.inline(rows))
    out = out.select("column_name", "dtype", "null_count", "n_rows")
    return out.where(F.col("null_count") > 0) if only_missing else out


# --------------------------------------------------------------------------
# Exact quantiles, distributed
# --------------------------------------------------------------------------

def _long_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, v) for every non-missing value of the given columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v"))
                      for c in columns])
    long = df.select(F.inline(pairs))
    return long.where(F.col("v").isNotNull() & ~F.isnan("v"))


def quantiles_by_column(df: DataFrame, columns: list[str], probs: list[float],
                        method: str = "exact", buckets: int = DEFAULT_QUANTILE_BUCKETS,
                        accuracy: int = 10000) -> DataFrame:
    """Linear-interpolated quantiles (pandas ``quantile`` / SQL ``quantile_cont``).

    Returns one row per column with at least one value: ``name, n, q0, q1,
    ...`` (q_i for probs[i]).

    ``method="exact"`` never builds a value->count map in one task and never
    sorts the whole column:

    1. distinct values are counted per column (map-side combined shuffle: a
       hot value is one row, so skew cannot pile up) and checkpointed once;
    2. every target rank starts with its column's whole value range. A range
       with more than ``RANGE_VALUES`` distinct values is cut at approximate
       quantiles (a bounded sketch -- it only balances the work, the answer does
       not depend on it), the values in the pieces are counted, and the target
       goes on with the piece that holds its rank, until all ranges are small;
    3. only those ranges (about 2 per quantile, each of a bounded number of
       rows whatever the column's size) are sorted, with a window, to read
       the values at the two ranks around each target.

    ``method="approx"`` uses ``percentile_approx`` for very large inputs.
    """
    spark = df.sparkSession
    long = _long_numeric(df, columns)
    if method == "approx":
        aggs = [F.count(F.lit(1)).alias("n")] + [
            F.percentile_approx("v", float(p), accuracy).alias(f"q{i}") for i, p in enumerate(probs)]
        return long.groupBy("name").agg(*aggs)
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")

    ensure_checkpoint_dir(spark)
    vc = long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("cnt")).checkpoint(eager=True)
    sizes = vc.groupBy("name").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("values")).collect()  # one row per column
    if not sizes:
        return small_frame(spark, [], "name string, n long, " + ", ".join(f"q{i} double" for i in range(len(probs))))
    meta, targets = [], []
    for r in sizes:
        h = [(r["n"] - 1) * float(p) for p in probs]
        meta.append((r["name"], r["n"], [x - math.floor(x) for x in h]))
        targets += [{"name": r["name"], "slot": f"{side}{i}", "lo": None, "hi": None, "rank": f(x), "values": r["values"]}
                    for i, x in enumerate(h) for side, f in (("lo", math.floor), ("hi", math.ceil))]
    while any(t["values"] > RANGE_VALUES for t in targets):
        _narrow(spark, vc, [t for t in targets if t["values"] > RANGE_VALUES], buckets, accuracy)
    own = _in_ranges(spark, vc, targets)
    w = Window.partitionBy("name", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("upto", F.sum("cnt").over(w))
    hit = own.where((F.col("upto") - F.col("cnt") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    picked = hit.groupBy("name").agg(*[F.max(F.when(F.col("slot") == s_, F.col("v"))).alias(s_)
                                       for i in range(len(probs)) for s_ in (f"lo{i}", f"hi{i}")])
    mdf = small_frame(spark, meta, "name string, n long, fr array<double>")
    out = picked.join(F.broadcast(mdf), "name")
    return out.select("name", "n", *[
        (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.get(F.col("fr"), i)).alias(f"q{i}")
        for i in range(len(probs))])


def _in_ranges(spark, vc: DataFrame, targets: list[dict]) -> DataFrame:
    """The value counts inside each target's range (lo, hi], with its slot and rank."""
    rows = small_frame(spark, [(t["name"], t["slot"], t["lo"], t["hi"], t["rank"]) for t in targets],
                       "name string, slot string, lo double, hi double, rank long")
    inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
    return vc.join(F.broadcast(rows), "name").where(inside)  # a few targets per column


def _narrow(spark, vc: DataFrame, targets: list[dict], buckets: int, accuracy: int) -> None:
    """Cut each target's range once and keep the piece that holds its rank (updates ``targets``)."""
    own = _in_ranges(spark, vc, targets)
    fracs = [i / max(2, buckets) for i in range(1, max(2, buckets))]
    cuts = {(r["name"], r["slot"]): sorted(set(r["b"])) for r in
            own.groupBy("name", "slot").agg(F.percentile_approx("v", fracs, accuracy).alias("b")).collect()}
    listed = small_frame(spark, [(n, k, [float(x) for x in b]) for (n, k), b in cuts.items()], "name string, slot string, cuts array<double>")
    piece = F.size(F.filter("cuts", lambda b: b < F.col("v")))
    pieces: dict[tuple, list] = {}
    for r in (own.join(F.broadcast(listed), ["name", "slot"]).groupBy("name", "slot", piece.alias("piece"))
              .agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("values")).collect()):  # targets x buckets numbers
        pieces.setdefault((r["name"], r["slot"]), []).append((r["piece"], r["n"], r["values"]))
    for t in targets:
        bounds = cuts[t["name"], t["slot"]]
        for k, n, values in sorted(pieces[t["name"], t["slot"]]):
            if t["rank"] < n:
                t["lo"] = bounds[k - 1] if k else t["lo"]
                t["hi"] = bounds[k] if k < len(bounds) else t["hi"]
                t["values"] = values
                break
            t["rank"] -= n


def one_row(per_column: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row-per-column statistics frame into a single wide row.

    ``fields`` maps a stat column (e.g. ``q0``) to an output suffix; the
    output has ``{column}{suffix}`` for every column. Bounded: input has one
    row per column.
    """
    aggs = [F.max(F.when(F.col("name") == F.lit(c), F.col(stat))).alias(f"{c}{suffix}")
            for c in columns for stat, suffix in fields.items()]
    return per_column.agg(*aggs)


def medians(df: DataFrame, columns: list[str], method: str = "exact") -> DataFrame:
    """One row: ``{c}__median`` for each column (A2)."""
    q = quantiles_by_column(df, columns, [0.5], method=method)
    return one_row(q, columns, {"q0": "__median"})


# --------------------------------------------------------------------------
# A3: modes
# --------------------------------------------------------------------------

def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-missing value per column; ties go to the smallest.

    One row: ``{c}__mode``. Value counts are a map-side combined shuffle, so a
    hot value is a single row; the final pick is a ``min`` over (-count, value).
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("s"))
                      for c in columns])
    long = df.select(F.inline(pairs)).where(F.col("s").isNotNull())
    counts = long.groupBy("name", "s").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("name").agg(F.min(F.struct((-F.col("cnt")).alias("k"), F.col("s"))).alias("m"))
    per_col = best.select("name", F.col("m.s").alias("mode"))
    return one_row(per_col, columns, {"mode": "__mode"})


# --------------------------------------------------------------------------
# imputation
# --------------------------------------------------------------------------

def columns_with_missing(df: DataFrame, columns: list[str]) -> list[str]:
    """The subset of ``columns`` holding at least one missing value: one
    aggregation pass, one number per column comes back."""
    if not columns:
        return []
    aggs = []
    for c in columns:
        x = F.col(f"`{c}`")
        miss = x.isNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            miss = miss | F.isnan(x)
        aggs.append(F.max(miss.cast("int")).alias(c))
    row = df.agg(*aggs).collect()[0]
    return [c for c in columns if row[c]]


def impute_median(df: DataFrame, columns: list[str] | None = None, method: str = "exact",
                  only_missing: bool = True) -> DataFrame:
    """Fill missing numbers with the column median (P5).

    Imputed columns become ``double`` (a median of integers may be
    fractional), as in pandas. NaN counts as missing. With ``only_missing``
    (the reference's behaviour) medians are computed only for columns that
    have a gap; the others keep their values and type.
    """
    cols = columns if columns is not None else numeric_columns(df)
    if only_missing:
        cols = columns_with_missing(df, cols)
    if not cols:
        return df
    stats = medians(df, cols, method=method)
    joined = df.crossJoin(F.broadcast(stats))
    repl = {}
    for c in cols:
        v = F.col(f"`{c}`").cast("double")
        repl[c] = F.coalesce(F.when(~F.isnan(v), v), F.col(f"`{c}__median`"))
    return joined.withColumns(repl).drop(*[f"{c}__median" for c in cols])


def impute_mode(df: DataFrame, columns: list[str] | None = None, default: str = "unknown",
                exclude: list[str] | None = None, only_missing: bool = True) -> DataFrame:
    """Fill missing strings with the most frequent value, else ``default``."""
    cols = columns if columns is not None else string_columns(df, exclude=exclude)
    if only_missing:
        cols = columns_with_missing(df, cols)
    if not cols:
        return df
    stats = modes(df, cols)
    joined = df.crossJoin(F.broadcast(stats))
    repl = {c: F.coalesce(F.col(f"`{c}`"), F.col(f"`{c}__mode`"), F.lit(default)) for c in cols}
    return joined.withColumns(repl).drop(*[f"{c}__mode" for c in cols])


# --------------------------------------------------------------------------
# A4 / F1 / A5: IQR fences
# --------------------------------------------------------------------------

def iqr_bounds(df: DataFrame, col: str, k: float = 1.5, method: str = "exact") -> DataFrame:
    """One row: q1, q3, iqr, lower, upper (A4)."""
    q = quantiles_by_column(df, [col], [0.25, 0.75], method=method)
    return (q.select(F.col("q0").alias("q1"), F.col("q1").alias("q3"))
             .select("q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))
             .select("q1", "q3", "iqr",
                     (F.col("q1") - F.lit(k) * F.col("iqr")).alias("lower"),
                     (F.col("q3") + F.lit(k) * F.col("iqr")).alias("upper")))


def _flag_inliers(df: DataFrame, col: str, k: float, method: str) -> tuple[DataFrame, Column]:
    # one row even where the column has no value at all: no row is then inside
    b = iqr_bounds(df, col, k=k, method=method).agg(
        F.max("lower").alias("__lower"), F.max("upper").alias("__upper"))
    joined = df.crossJoin(F.broadcast(b))
    keep = (F.col(f"`{col}`") >= F.col("__lower")) & (F.col(f"`{col}`") <= F.col("__upper"))
    return joined, F.coalesce(keep, F.lit(False))


def iqr_filter(df: DataFrame, col: str, k: float = 1.5, method: str = "exact") -> DataFrame:
    """Keep rows with lower <= col <= upper; a missing value is dropped (F1)."""
    joined, keep = _flag_inliers(df, col, k, method)
    return joined.where(keep).drop("__lower", "__upper")


def outlier_report(df: DataFrame, col: str, k: float = 1.5, method: str = "exact") -> DataFrame:
    """One row: before, after, removed, removed_share (A5)."""
    joined, keep = _flag_inliers(df, col, k, method)
    counts = joined.agg(F.count(F.lit(1)).alias("before"), F.count_if(keep).alias("after"))
    return counts.select(
        "before", "after", (F.col("before") - F.col("after")).alias("removed"),
        F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before"))
         .alias("removed_share"))


# --------------------------------------------------------------------------
# Population standard scaler
# --------------------------------------------------------------------------

def fit_standard_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with ``{c}__mean`` and ``{c}__std`` (population std; 0 -> 1)."""
    aggs = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)  # NaN is missing, as in the reference's scaler
        aggs.append(F.avg(v).alias(f"{c}__mean"))
        aggs.append(F.stddev_pop(v).alias(f"{c}__sd"))
    stats = df.agg(*aggs)
    fixed = [F.col(f"{c}__mean") for c in columns] + [
        F.when(F.col(f"{c}__sd") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__sd")).alias(f"{c}__std")
        for c in columns]
    return stats.select(*fixed)


def apply_standard_scaler(df: DataFrame, scaler: DataFrame, columns: list[str],
                          suffix: str = "") -> DataFrame:
    """(x - mean) / std with the fitted one-row ``scaler`` (broadcast)."""
    joined = df.crossJoin(F.broadcast(scaler))
    out = {f"{c}{suffix}": (F.col(f"`{c}`").cast("double") - F.col(f"{c}__mean")) / F.col(f"{c}__std")
           for c in columns}
    return joined.withColumns(out).drop(*[f"{c}__{s}" for c in columns for s in ("mean", "std")])
