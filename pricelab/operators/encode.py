"""One-hot encoding of string columns.

Two forms, chosen by the caller and never by the data: :func:`one_hot` makes
one column per category (categories come from a distributed ``distinct``; more
than ``max_categories`` raise, since each becomes a column of the plan), and
:func:`one_hot_vector` makes one sparse vector per column at any number of
categories. Both are frozen at fit time and reused at scoring, so the output
never depends on the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_CATEGORIES = 256


def categories(df: DataFrame, col: str, max_categories: int = DEFAULT_MAX_CATEGORIES) -> list[str]:
    """Sorted distinct non-missing values (A9); at most ``max_categories``."""
    vals = (df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull())
              .distinct().orderBy("v").limit(max_categories + 1).collect())
    if len(vals) > max_categories:
        raise ValueError(f"{col} has more than {max_categories} categories; "
                         "use StringIndexer + OneHotEncoder for high cardinality")
    return [r["v"] for r in vals]


def one_hot_vector(df: DataFrame, col: str, out_col: str | None = None, model=None):
    """High-cardinality form of P10: Spark ML ``StringIndexer`` (alphabetical,
    unseen / missing values kept as an extra index) + ``OneHotEncoder``
    (``dropLast=False``) into one sparse vector column. Returns the frame and
    the fitted pipeline; pass it as ``model`` at scoring, so the width stays
    that of the fit."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    out = out_col or f"{col}_vec"
    idx = StringIndexer(inputCol=col, outputCol=f"{col}__idx", handleInvalid="keep",
                        stringOrderType="alphabetAsc")
    enc = OneHotEncoder(inputCols=[f"{col}__idx"], outputCols=[out], dropLast=False)
    model = model or Pipeline(stages=[idx, enc]).fit(df)
    return model.transform(df).drop(f"{col}__idx"), model


def one_hot_long(df: DataFrame, vector_col: str, key: list[str]) -> DataFrame:
    """The non-zero entries of a sparse vector column in long form: ``key``, ``slot``, ``value`` (no row for an empty vector)."""
    cells = F.unwrap_udt(F.col(vector_col))
    pairs = F.arrays_zip(cells["indices"].alias("slot"), cells["values"].alias("value"))
    return df.select(*key, F.inline(pairs)).where(F.col("value") != 0)


def one_hot(df: DataFrame, columns: list[str], vocab: dict[str, list[str]] | None = None,
            max_categories: int = DEFAULT_MAX_CATEGORIES, drop: bool = True) -> tuple[DataFrame, dict[str, list[str]]]:
    """Replace each column by ``{col}_{value}`` 0/1 int columns, sorted by
    value, appended at the end; a missing value is all zeros. Returns the
    frame and the vocabulary used (to reuse at scoring). A column with more
    than ``max_categories`` values raises: use :func:`one_hot_vector`."""
    vocab = dict(vocab or {})
    for c in columns:
        if c not in vocab:
            vocab[c] = categories(df, c, max_categories)
    new = {f"{c}_{v}": F.when(F.col(c).cast("string") == F.lit(v), F.lit(1)).otherwise(F.lit(0))
           for c in columns for v in vocab[c]}
    kept = [x for x in df.columns if not (drop and x in columns)]
    return df.select(*kept, *[e.alias(n) for n, e in new.items()]), vocab
