"""Column-name cleaning and column-role detection (planning-time, schema only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def clean_name(name: str) -> str:
    """strip, lower-case, spaces and dots to underscores."""
    return name.strip().lower().replace(" ", "_").replace(".", "_")


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`clean_name`; refuse collisions.

    ``toDF`` renames positionally, so dotted source names need no escaping.
    """
    new = [clean_name(c) for c in df.columns]
    dupes = sorted({c for c in new if new.count(c) > 1})
    if dupes:
        raise ValueError(f"cleaned column names collide: {dupes}")
    return df.toDF(*new)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TIME)


def time_columns(df: DataFrame) -> list[str]:
    """Columns whose name contains ``date`` or ``time`` (the reference's rule)."""
    return [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]


def price_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "price" in c.lower()]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    skip = set(exclude or [])
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


@dataclass(frozen=True)
class Roles:
    time_col: str | None
    price_col: str | None
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]


def detect_roles(df: DataFrame, time_col: str | None = None, price_col: str | None = None,
                 fallback_to_numeric: bool = True) -> Roles:
    """Find time / price / categorical columns.

    Explicit arguments win; otherwise the substring rules apply: first name
    containing ``date``/``time`` is the time column, first name containing
    ``price`` is the price, and (cleaning only) the first numeric column is
    the fallback price.
    """
    times = time_columns(df)
    t = time_col or (times[0] if times else None)
    numeric = numeric_columns(df)
    p = price_col
    if p is None:
        prices = price_columns(df)
        if prices:
            p = prices[0]
        elif fallback_to_numeric and numeric:
            p = numeric[0]
    cats = tuple(string_columns(df, exclude=times))
    return Roles(t, p, cats, tuple(numeric))
