"""The cleaning run (reference entry 1) as one lazy plan.

clean names -> parse times -> impute numbers (median) -> impute strings (mode)
-> calendar features -> IQR filter on the price. Medians are taken before the
outlier filter and quartiles after imputation, as in the reference. Two small
statistics jobs (medians+modes, quartiles) feed broadcast one-row frames; the
rows themselves are only scanned, projected and filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.functions.calendar import add_calendar_features, parse_times, unparsed_times
from pricelab.functions.names import clean_names, detect_roles, time_columns
from pricelab.operators.stats import impute_median, impute_mode, iqr_filter
from pricelab.sources.prices import nan_to_null


def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if df.schema[c].dataType.typeName() in ("double", "float"):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def clean_prices(df: DataFrame, time_col: str | None = None, price_col: str | None = None,
                 impute_exclude: list[str] | None = None, remove_outliers: bool = True,
                 quantile_method: str = "exact", time_formats: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Return the clean frame and the roles used.

    ``time_formats`` are tried in turn after ISO; ``roles["unparsed_times"]``
    counts the time texts that none of them fits (they become NULL). NaN is
    missing."""
    x = nan_to_null(clean_names(df))
    times = list(dict.fromkeys([*time_columns(x), *([time_col] if time_col else [])]))
    unparsed = unparsed_times(x, times, time_formats)
    if unparsed is not None:
        x = x.withColumn("__unparsed", unparsed)  # from the texts, before they are replaced
    x = parse_times(x, times, time_formats)
    roles = detect_roles(x.drop("__unparsed"), time_col=time_col, price_col=price_col)
    skip = {*(impute_exclude or []), *times}
    num = [c for c in roles.numeric if c not in skip]
    cats = [c for c in roles.categorical if c not in skip]
    # one profiling pass (the reference tests each column separately): which
    # columns have gaps, and whether the time column has any value at all
    probe = [F.max(_missing(x, c).cast("int")).alias(c) for c in num + cats]
    if roles.time_col:
        probe.append(F.max(F.col(roles.time_col).isNotNull().cast("int")).alias("__has_time"))
    if unparsed is not None:
        probe.append(F.sum("__unparsed").alias("__n_unparsed"))
    flags = x.agg(*probe).collect()[0] if probe else {}
    x = x.drop("__unparsed")
    x = impute_median(x, [c for c in num if flags[c]], method=quantile_method, only_missing=False)
    x = impute_mode(x, [c for c in cats if flags[c]], only_missing=False)
    if roles.time_col and flags["__has_time"]:
        x = add_calendar_features(x, roles.time_col, guard=False)
    if remove_outliers and roles.price_col:
        x = iqr_filter(x, roles.price_col, method=quantile_method)
    return x, {"time_col": roles.time_col, "price_col": roles.price_col,
               "numeric": num, "categorical": cats,
               "unparsed_times": (flags["__n_unparsed"] or 0) if unparsed is not None else 0}
