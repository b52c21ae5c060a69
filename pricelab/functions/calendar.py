"""Calendar features and time parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Day names indexed by day_of_week (Monday = 0).
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c, fmt: str | list[str] | None = None) -> Column:
    """Lenient parse: a value that does not parse becomes NULL. Several formats
    are tried in turn, after ISO.

    Returns ``timestamp_ntz`` so results do not depend on the session zone.
    Timestamp inputs pass through unchanged.
    """
    col = _c(c)
    if fmt is None:
        return col.cast("string").try_cast("timestamp_ntz")
    if not isinstance(fmt, str):
        return F.coalesce(parse_time(col), *[parse_time(col, f) for f in fmt])
    return F.try_to_timestamp(col.cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def parse_time_strict(c, fmt: str | None = None) -> Column:
    """Strict parse: a bad value raises (ANSI cast)."""
    col = _c(c)
    if fmt is None:
        return col.cast("timestamp_ntz")
    return F.to_timestamp(col, fmt).cast("timestamp_ntz")


def unparsed_times(df: DataFrame, columns: list[str], fmt: str | list[str] | None = None) -> Column | None:
    """How many of a row's text times hold a value that does not parse (None
    without text times)."""
    texts = [f.name for f in df.schema.fields if f.name in columns and f.dataType.simpleString() == "string"]
    bad = [(F.col(f"`{c}`").isNotNull() & parse_time(F.col(f"`{c}`"), fmt).isNull()).cast("long") for c in texts]
    return sum(bad[1:], bad[0]) if bad else None


def parse_times(df: DataFrame, columns: list[str] | None = None, fmt: str | list[str] | None = None) -> DataFrame:
    """Parse every time-role column that is stored as text.

    Numeric and already-temporal columns are left alone.
    """
    from pricelab.functions.names import is_time, time_columns

    cols = columns if columns is not None else time_columns(df)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    todo = [c for c in cols if c in types and not is_time(types[c])
            and types[c].simpleString() == "string"]
    if not todo:
        return df
    return df.withColumns({c: parse_time(F.col(c), fmt) for c in todo})


def day_of_week(ts) -> Column:
    """Monday = 0 .. Sunday = 6; NULL for a NULL time."""
    return F.weekday(_c(ts))


def weekend_flag(ts) -> Column:
    """1 on Saturday/Sunday, else 0 (also 0 for a missing time)."""
    return F.when(F.weekday(_c(ts)) >= 5, F.lit(1)).otherwise(F.lit(0))


def day_name(dow) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), _c(dow) + 1)


def add_calendar_features(df: DataFrame, time_col: str, guard: bool = True) -> DataFrame:
    """Append day_of_week, month, year, hour_of_day, is_weekend.

    The reference adds them only when the time column has at least one value
    (F5). With ``guard`` the check is one ``LIMIT 1`` probe on non-null times,
    which stops at the first hit instead of scanning the table.
    """
    if guard and df.where(F.col(time_col).isNotNull()).select(time_col).limit(1).count() == 0:
        return df
    ts = F.col(time_col)
    return df.withColumns({
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "hour_of_day": F.hour(ts),
        "is_weekend": weekend_flag(ts),
    })
