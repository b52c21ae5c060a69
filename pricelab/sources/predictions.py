"""Stored predictions files: one row per time, one column per model (P2, P13, C4-C7 from a file).

A file's header says what it holds: ``actual_{target}``, ``{model}_predicted_{target}`` and, where somebody has already
computed it, ``{model}_error``. Everything else (time, keys) is carried. Files are read into the long form that all
metric and chart operators take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.sources import prices

# The name parts of a stored predictions file.
ACTUAL = "actual_"
PREDICTED = "_predicted_"
ERROR = "_error"


def target_of(columns: list[str]) -> str:
    """The target's name: what follows ``actual_`` in the first column that begins so."""
    for c in columns:
        if c.startswith(ACTUAL) and len(c) > len(ACTUAL):
            return c[len(ACTUAL):]
    raise ValueError("no column begins with 'actual_': not a predictions file")


def models_of(columns: list[str], target: str) -> list[str]:
    """The models with predictions of ``target``, in the header's order."""
    end = PREDICTED + target
    return [c[: -len(end)] for c in columns if c.endswith(end) and len(c) > len(end)]


def to_wide(aligned: DataFrame, target: str, models: list[str], errors: list[str] | None = None) -> DataFrame:
    """Aligned predictions (``actual``, ``{model}_predicted``, ``{model}_error``) under the names of a stored file.

    ``errors``: the models whose error column is kept (default: all that have one)."""
    errors = [m for m in models if f"{m}{ERROR}" in aligned.columns] if errors is None else errors
    names = {"actual": ACTUAL + target, **{f"{m}_predicted": m + PREDICTED + target for m in models}}
    dropped = [f"{m}{ERROR}" for m in models if m not in errors]
    return aligned.drop(*dropped).withColumnsRenamed(names)


def to_long(wide: DataFrame) -> DataFrame:
    """One row per carried columns and model: ..., ``model``, ``actual``, ``predicted``, ``error``.

    A stored error is taken as it is; where the file has no such column it is actual - predicted. A model without a
    prediction in a row (missing, or no number) has no row there. Text columns of numbers are cast."""
    target = target_of(wide.columns)
    models = models_of(wide.columns, target)
    own = {ACTUAL + target, *[m + PREDICTED + target for m in models], *[m + ERROR for m in models if m + ERROR in wide.columns]}
    rest = [c for c in wide.columns if c not in own]

    def number(c: str):
        value = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(value), value)

    actual = number(ACTUAL + target)
    rows = []
    for m in models:
        predicted = number(m + PREDICTED + target)
        error = number(m + ERROR) if m + ERROR in wide.columns else actual - predicted
        rows.append(F.struct(F.lit(m).alias("model"), actual.alias("actual"), predicted.alias("predicted"), error.alias("error")))
    if not rows:
        raise ValueError(f"no model predicts {target!r} in this file")
    return wide.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(*rows))).where(F.col("predicted").isNotNull())


def read_latest(spark: SparkSession, folder: str, glob: str = "*.csv", fmt: str = "csv") -> DataFrame:
    """The most recent predictions file of a folder in long form (S3; see :func:`to_long`)."""
    return to_long(prices.scan_latest(spark, folder, glob, fmt))


def read_run(spark: SparkSession, base: str, fmt: str = "csv") -> DataFrame:
    """The most recent finished run under ``base`` (all its files) in long form."""
    reader = spark.read.format(fmt)
    reader = reader.option("header", "true") if fmt == "csv" else reader
    return to_long(reader.load(prices.latest_run(spark, base, f"*.{fmt}")))
