"""Prediction errors, regression metrics and model comparison (P13, P14, P17,
A11, A12, M5, J3, C7, T7).

Predictions travel in long form ``(key..., model, split, actual, predicted)``
so any number of models share one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric labels of the comparison table, in display order, and
# the label used when both models have the same test RMSE.
METRIC_LABELS = [
    ("train", "rmse", "Training RMSE"),
    ("test", "rmse", "Testing RMSE"),
    ("train", "mae", "Training MAE"),
    ("test", "mae", "Testing MAE"),
    ("train", "r2", "Training R²"),
    ("test", "r2", "Testing R²"),
]
TIE_LABEL = "similar"


def with_errors(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                out: str = "error") -> DataFrame:
    """error = actual - predicted, unless the column is already there."""
    if out in df.columns:
        return df
    return df.withColumn(out, F.col(actual) - F.col(predicted))


def regression_metrics(pred_long: DataFrame, group_cols: tuple[str, ...] = ("model", "split"),
                       actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """n, rmse, mae, mse, r2 per group (A11, A12), one pass.

    r2 = 1 - SSE / SST with SST = var_pop(actual) * n -- the coefficient of
    determination, not the squared correlation. Constant actuals: 1 when the
    fit is exact, else 0.
    """
    e = F.col(actual) - F.col(predicted)
    agg = pred_long.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("sse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(actual).alias("vp"))
    sst = F.col("vp") * F.col("n")
    r2 = (F.when(sst > 0, F.lit(1.0) - F.col("sse") / sst)
           .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(*group_cols, "n",
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                      "mae",
                      (F.col("sse") / F.col("n")).alias("mse"),
                      r2.alias("r2"))


def metric_long(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """(metric, model, value) with the display labels, rounded."""
    labels = F.create_map(*[x for split, m, label in METRIC_LABELS
                            for x in (F.lit(f"{split}|{m}"), F.lit(label))])
    stacked = metrics.select("model", "split", F.inline(F.array(
        *[F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in ("rmse", "mae", "r2")])))
    out = stacked.select(F.element_at(labels, F.concat_ws("|", "split", "m")).alias("metric"),
                         "model", F.round("value", digits).alias("value"))
    return out.where(F.col("metric").isNotNull())


def metric_table(metrics: DataFrame, models: list[str], digits: int = 4) -> DataFrame:
    """metric x model table, one column per model (M5). ``models`` fixes the
    output columns, so the pivot needs no extra job."""
    return metric_long(metrics, digits).groupBy("metric").pivot("model", models).agg(F.first("value"))


def format_metric(value: Column, digits: int = 4) -> Column:
    """Text form as written in the comparison files."""
    return F.format_string(f"%.{digits}f", value)


def parse_metric(text: Column) -> Column:
    """Metric text to double, leading '-' included (P17); bad text -> NULL."""
    return F.trim(text).try_cast("double")


def model_winner(metrics: DataFrame, models: tuple[str, str]) -> DataFrame:
    """One row: the model with the lower test RMSE, or ``similar`` on a tie."""
    a, b = models
    t = metrics.where(F.col("split") == "test").agg(
        F.max(F.when(F.col("model") == a, F.col("rmse"))).alias(f"{a}_test_rmse"),
        F.max(F.when(F.col("model") == b, F.col("rmse"))).alias(f"{b}_test_rmse"))
    ra, rb = F.col(f"{a}_test_rmse"), F.col(f"{b}_test_rmse")
    win = F.when(ra < rb, F.lit(a)).when(rb < ra, F.lit(b)).otherwise(F.lit(TIE_LABEL))
    return t.select(win.alias("winner"), ra, rb)


def aligned_predictions(actuals: DataFrame, predictions: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Actuals with each model's prediction aligned on the row key.

    ``predictions[name]`` holds key + ``predicted`` (the largest counts where a
    key has several). Every row of ``actuals`` is kept, equal keys included; a
    model without a prediction for a row (e.g. the first sequence rows, or a
    NULL in the key) gives NULL there. The reference paired rows by position
    instead, which shifted one model. All predictions are grouped by key in
    one shuffle, and that partitioning serves the left join with the actuals.
    """
    tagged = [p.select(*key, *[(F.col("predicted").cast("double") if n == name else F.lit(None).cast("double"))
                               .alias(f"{n}_predicted") for n in predictions])
              for name, p in predictions.items()]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t)
    by_key = u.groupBy(*key).agg(*[F.max(f"{n}_predicted").alias(f"{n}_predicted") for n in predictions])
    g = actuals.join(by_key, key, "left")
    return g.withColumns({f"{n}_error": F.col("actual") - F.col(f"{n}_predicted") for n in predictions})


def recent_predictions(pred: DataFrame, time_col: str = "ts", n: int = 20,
                       tie_break: list[str] | None = None) -> DataFrame:
    """The ``n`` latest predictions (T7) -- a top-k (``TakeOrdered``), the
    limit is the feature."""
    order = [F.col(time_col).desc()] + [F.col(c).desc() for c in (tie_break or [])]
    return pred.orderBy(*order).limit(n)
