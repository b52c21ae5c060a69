"""The forecasting run (reference entry 2) on Spark ML.

clean -> encode -> position / chronological split -> scale (fitted on train)
-> {boosted trees, sequence windows -> linear model} -> long predictions ->
metrics -> writes. Spark ML trains on the executors (``treeAggregate`` for
the trees, one normal-equation pass for the linear model); only fitted
parameters live on the driver.

The reference's recurrent network is re-aimed: the 24-step windows it would
read are flattened into one vector and fed to ``LinearRegression``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.functions.calendar import add_calendar_features
from pricelab.operators import encode, metrics, series, stats
from pricelab.session import small_frame
from pricelab.sinks import writers

# Boosted-tree settings of the reference run (100 trees, rate
# 0.05, depth 6, min child 1, row and column sampling 0.8, seed 42), the
# sequence length and the split shares.
GBT_PARAMS = dict(maxIter=100, stepSize=0.05, maxDepth=6, minInstancesPerNode=1,
                  subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
SEQUENCE_LENGTH = 24
TEST_SIZE = 0.2
VALIDATION_SHARE = 0.2
#: Rows that the trees are fitted on, by partition: a table of fewer fills one, and no partition holds more than the second.
FEW_ROWS, MANY_ROWS = 1 << 15, 1 << 20
PARTS_PER_CORE = 2


@dataclass
class Prepared:
    frame: DataFrame                   # key, ts, split, split_pos, fold, label, raw + scaled features
    feature_cols: list[str]
    target: str
    key: list[str]
    scaler: DataFrame                  # one row: {c}__mean, {c}__std
    vocab: dict = field(default_factory=dict)


def feature_columns(df: DataFrame, target: str, exclude: list[str] | None = None) -> list[str]:
    """Every column except the target, the time-role columns and the
    given keys; string columns must be encoded first."""
    from pricelab.functions.names import time_columns

    skip = {target, *time_columns(df), *(exclude or [])}
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in skip]
    if strings:
        raise ValueError(f"encode string columns before training: {strings}")
    return [c for c in df.columns if c not in skip]


def event_features(events: DataFrame, order_by: list[str], lags: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, list[str]]:
    """Feature table for ``events``: calendar fields, one-hot event type,
    user, value lags, target ``value``. Carries ``pos`` (global time
    position). The first rows have no earlier value: their lags take the
    series median, computed once on the base table (not on the windowed
    frame, which would re-run the lag window for every statistics pass)."""
    med = stats.medians(events, ["value"])
    x = add_calendar_features(events, "ts", guard=False)
    x = stats.impute_mode(x, ["event_type"])
    x, vocab = encode.one_hot(x, ["event_type"])
    x = series.with_row_position(x, order_by)
    x = series.lag_features(x, ["value"], list(lags))
    lag_cols = [f"value_lag{k}" for k in lags]
    x = x.crossJoin(F.broadcast(med)).withColumns(
        {c: F.coalesce(F.col(c), F.col("value__median")) for c in lag_cols}).drop("value__median")
    feats = ["user_id", "hour_of_day", "day_of_week", "month", "is_weekend",
             *[f"event_type_{v}" for v in vocab["event_type"]], *lag_cols]
    return x, feats


def prepare(df: DataFrame, feature_cols: list[str], target: str, key: list[str], order_by: list[str],
            test_size: float = TEST_SIZE) -> Prepared:
    """Chronological split, a hash fold (``fit`` / ``validation``) inside
    train, the population scaler fitted on train and applied everywhere, and
    the assembled ``features`` vector."""
    s = series.chronological_split(df, order_by, test_size=test_size)
    s = series.hash_split(s, key, train_share=1 - VALIDATION_SHARE, split_col="fold",
                          labels=("fit", "validation"))
    # both models scan the result many times: cut the lineage (positions,
    # lag windows, imputation) once in the shared checkpoint folder, and fix
    # the one-row scaler the same way so no later pass recomputes either
    s = s.checkpoint(eager=True)
    gaps = stats.columns_with_missing(s, feature_cols)
    if gaps:  # a missing feature takes the train median (0 where train holds no value), as at scoring of raw rows
        middle = stats.medians(s.where(F.col("split") == "train"), gaps).checkpoint(eager=True)
        value = {c: F.col(f"`{c}`").cast("double") for c in gaps}
        s = s.crossJoin(F.broadcast(middle)).withColumns(
            {c: F.coalesce(F.when(~F.isnan(v), v), F.col(f"`{c}__median`"), F.lit(0.0)) for c, v in value.items()}).drop(*middle.columns)
    scaler = stats.fit_standard_scaler(s.where(F.col("split") == "train"), feature_cols).checkpoint(eager=True)
    x = stats.apply_standard_scaler(s, scaler, feature_cols, suffix="__z")
    z = [f"{c}__z" for c in feature_cols]
    x = x.withColumn("xarr", F.array(*[F.col(c) for c in z]))
    x = x.withColumn("xraw", F.array(*[F.col(c).cast("double") for c in feature_cols]))
    x = x.withColumn("features", array_to_vector("xarr"))
    time_col = order_by[0]  # the series time; carried as ``ts``
    x = x.select(*key, F.col(time_col).alias("ts"), "split", "split_pos", "fold",
                 F.col(target).cast("double").alias("label"), "xraw", "xarr", "features")
    return Prepared(x, feature_cols, target, key, scaler)


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over partitions whose number follows the rows and the cores, not the shuffles before.

    A tree takes a job of two stages per level, and each task hands on the statistics of all the level's nodes: at
    one partition per shuffle partition, tasks and shuffled statistics grow with the table on top of its rows, and
    partitions that hold test rows only (a range of time) leave cores idle."""
    n = rows.count()
    most = PARTS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    # the fit reads them several times, from plans of its own: dealt once
    return rows.repartition(max(1, min(-(-n // FEW_ROWS), most), -(-n // MANY_ROWS))).checkpoint(eager=True)


def train_gbt(prep: Prepared, params: dict | None = None) -> GBTRegressionModel:
    """M1: fitted on the ``fit`` fold of train (the validation fold is held
    out for the per-round curve, as the reference's eval set)."""
    p = dict(GBT_PARAMS)
    p.update(params or {})
    fit = prep.frame.where((F.col("split") == "train") & (F.col("fold") == "fit")).select("label", "features")
    return GBTRegressor(featuresCol="features", labelCol="label", **p).fit(_spread(fit))


def gbt_predictions(prep: Prepared, model: GBTRegressionModel) -> DataFrame:
    out = model.transform(prep.frame)
    return out.select(*prep.key, "ts", "split", "split_pos", F.lit("tree").alias("model"),
                      F.col("label").alias("actual"), F.col("prediction").alias("predicted"))


def training_curve(prep: Prepared, model: GBTRegressionModel) -> list[tuple[int, float]]:
    """M3: squared loss on the validation fold after each tree (one
    distributed pass per call; the list length is the tree count)."""
    val = prep.frame.where((F.col("split") == "train") & (F.col("fold") == "validation"))
    losses = model.evaluateEachIteration(val, "squared")
    return [(i + 1, float(v)) for i, v in enumerate(losses)]


def feature_importance(spark: SparkSession, prep: Prepared, model: GBTRegressionModel, top: int = 20) -> DataFrame:
    """Normalised impurity importances with names, descending,
    top ``top`` (the vector is one value per feature: bounded)."""
    imp = model.featureImportances.toArray().tolist()
    rows = list(zip(prep.feature_cols, [float(v) for v in imp]))
    df = small_frame(spark, rows, "feature string, importance double")
    total = df.agg(F.sum("importance").alias("t"))
    return (df.crossJoin(F.broadcast(total))
              .select("feature", "importance",
                      F.when(F.col("t") > 0, F.col("importance") / F.col("t")).otherwise(F.lit(0.0)).alias("share"))
              .orderBy(F.col("importance").desc(), "feature").limit(top))


def gain_importance(model: GBTRegressionModel, feature_names: list[str], top: int = 15) -> DataFrame:
    """M4/T2 by gain: the features with the largest mean gain of a split over all trees (``feature``, ``gain``, ``splits``).

    Read from the stored trees' node table, one row a node, with Spark: a split's gain is its drop in squared error
    over the rows it cuts (the node's impurity gain times its rows). Features without a split have gain 0."""
    from pricelab.session import scratch_path

    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*").where("leftChild >= 0")
    per = nodes.groupBy(F.col("split.featureIndex").alias("__at")).agg(
        F.avg(F.col("gain") * F.col("rawCount")).alias("gain"), F.count(F.lit(1)).alias("splits"))
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in feature_names])).alias("__at", "feature"))  # one a feature
    out = names.join(per, "__at", "left").select("feature", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("splits", F.lit(0)).alias("splits"))
    return out.orderBy(F.col("gain").desc(), "feature").limit(top)


def sequence_frame(prep: Prepared, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """W1 windows of the scaled feature rows per split, flattened to one
    vector (time-major) in ``seq_features``."""
    w = series.sequence_windows(prep.frame, [], "label", length=length, pos_col="split_pos",
                                partition_cols=["split"], out_col="seq", feature_array_col="xarr")
    return (w.withColumn("seq_features", array_to_vector(F.flatten("seq")))
            .select(*prep.key, "ts", "split", "split_pos", "label", "seq_features"))


def train_sequence(prep: Prepared, length: int = SEQUENCE_LENGTH, reg: float = 0.01,
                   elastic: float = 0.0) -> tuple[LinearRegressionModel, DataFrame]:
    """M2 (re-aimed): linear model on the flattened windows of train."""
    # read by the fit and by the predictions: computed once
    seqs = sequence_frame(prep, length).checkpoint(eager=True)
    lr = LinearRegression(featuresCol="seq_features", labelCol="label", regParam=reg,
                          elasticNetParam=elastic, solver="auto")
    model = lr.fit(seqs.where(F.col("split") == "train"))
    return model, seqs


def sequence_predictions(prep: Prepared, model: LinearRegressionModel, seqs: DataFrame) -> DataFrame:
    out = model.transform(seqs)
    return out.select(*prep.key, "ts", "split", "split_pos", F.lit("sequence").alias("model"),
                      F.col("label").alias("actual"), F.col("prediction").alias("predicted"))


def save_models(path: str, prep: Prepared, gbt: GBTRegressionModel, seq: LinearRegressionModel | None,
                length: int = SEQUENCE_LENGTH) -> None:
    """K5: models, scaler row and metadata (features, sequence length,
    target, training time) under one folder."""
    gbt.write().overwrite().save(f"{path}/tree")
    if seq is not None:
        seq.write().overwrite().save(f"{path}/sequence")
    prep.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    meta = {"feature_names": prep.feature_cols, "sequence_length": length, "target_column": prep.target,
            "training_date": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")}
    spark = prep.frame.sparkSession
    small_frame(spark, [(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/metadata")


def load_models(spark: SparkSession, path: str) -> tuple[GBTRegressionModel, DataFrame, dict]:
    """K6: load once, reuse for every batch."""
    gbt = GBTRegressionModel.load(f"{path}/tree")
    scaler = spark.read.parquet(f"{path}/scaler")
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["meta"])
    return gbt, scaler, meta


def load_sequence_model(spark: SparkSession, path: str) -> LinearRegressionModel | None:
    from pricelab.session import path_exists

    p = f"{path}/sequence"
    return LinearRegressionModel.load(p) if path_exists(spark, p) else None


def score_sequence(records: DataFrame, model: LinearRegressionModel, scaler: DataFrame,
                   feature_cols: list[str], pos_col: str, length: int = SEQUENCE_LENGTH,
                   array_col: str = "features_raw",
                   partition_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """M6 for the sequence model: each scored row needs the ``length``
    preceding rows, so raw lists are scaled, windowed over ``pos_col``
    (block-halo windows, no single-task sort) and flattened like at training.

    Returns (scored, rejected). A list that is missing, has another width or
    holds a missing value is bad; windows are cut over all rows first, and a row
    whose window holds a bad list is rejected, not shifted. A bad row itself is
    scored if its window is good (its own list is not part of it). Rows with
    fewer than ``length`` predecessors are in neither output."""
    cols = {c: F.get(F.col(array_col), i) for i, c in enumerate(feature_cols)}
    x = stats.apply_standard_scaler(records.withColumns(cols), scaler, feature_cols, suffix="__z")
    z = F.array(*[F.col(f"{c}__z") for c in feature_cols])
    # a bad list becomes an empty one, which keeps its place in every window
    x = x.withColumn("__xz", F.when(_good_list(F.col(array_col), len(feature_cols)), z)
                     .otherwise(F.array().cast("array<double>"))) \
        .drop(*feature_cols, *[f"{c}__z" for c in feature_cols])
    w = series.sequence_windows(x, [], "", length=length, pos_col=pos_col, partition_cols=partition_cols,
                                out_col="__seq", feature_array_col="__xz").drop("__xz")
    whole = F.size(F.flatten("__seq")) == length * len(feature_cols)
    ready = w.where(whole).withColumn("seq_features", array_to_vector(F.flatten("__seq"))).drop("__seq")
    return model.transform(ready).drop("seq_features"), w.where(~whole).drop("__seq")


def _good_list(values: Column, width: int) -> Column:
    """Whether a feature list is there, has the right width and holds no missing value."""
    missing = F.exists(values, lambda v: v.isNull() | F.isnan(v))
    return (F.coalesce(F.size(values), F.lit(-1)) == width) & ~F.coalesce(missing, F.lit(True))


def score_features(records: DataFrame, model: GBTRegressionModel, scaler: DataFrame, feature_cols: list[str],
                   array_col: str = "features_raw") -> tuple[DataFrame, DataFrame]:
    """Score raw feature lists. Rows whose list is missing, has another
    width than the model or holds a missing value are rejected (second frame);
    the rest are scaled with the stored scaler and scored. Every row is in one
    of the two."""
    good = _good_list(F.col(array_col), len(feature_cols))
    ok, bad = records.where(good), records.where(~good)
    cols = {c: F.get(F.col(array_col), i) for i, c in enumerate(feature_cols)}
    x = stats.apply_standard_scaler(ok.withColumns(cols), scaler, feature_cols, suffix="__z")
    x = x.withColumn("features", array_to_vector(F.array(*[F.col(f"{c}__z") for c in feature_cols])))
    scored = model.transform(x).drop(*feature_cols, *[f"{c}__z" for c in feature_cols], "features")
    return scored, bad


@dataclass
class ForecastRun:
    """What a forecasting run leaves: fitted parts, frames, and where they were written."""

    prepared: Prepared
    tree: GBTRegressionModel
    sequence: LinearRegressionModel
    predictions: DataFrame             # long form, both models
    metrics: DataFrame                 # long form: metric, model, value
    winner: DataFrame                  # one row
    aligned: DataFrame                 # actuals with both models' predictions
    importance: DataFrame
    paths: dict = field(default_factory=dict)


def run_forecast(df: DataFrame, feature_cols: list[str], target: str, key: list[str], order_by: list[str],
                 out: str | None = None, gbt_params: dict | None = None, length: int = SEQUENCE_LENGTH,
                 stamp: str | None = None) -> ForecastRun:
    """M7: the whole run on any table of numeric features: split -> scale -> two
    models -> metrics and winner -> aligned predictions -> importances, and with
    ``out`` the writes (predictions, metrics, models) under it."""
    spark = df.sparkSession
    prep = prepare(df, feature_cols, target, key, order_by)
    gbt = train_gbt(prep, gbt_params)
    seq_model, seqs = train_sequence(prep, length)
    preds = gbt_predictions(prep, gbt).unionByName(sequence_predictions(prep, seq_model, seqs)).checkpoint(eager=True)
    measured = metrics.regression_metrics(preds)
    test = preds.where(F.col("split") == "test")
    actual = test.where(F.col("model") == "tree").select(*key, "ts", "actual")
    by_model = {m: test.where(F.col("model") == m).select(*key, "predicted") for m in ("tree", "sequence")}
    run = ForecastRun(prep, gbt, seq_model, preds, metrics.metric_long(measured),
                      metrics.model_winner(measured, ("tree", "sequence")),
                      metrics.aligned_predictions(actual, by_model, key),
                      feature_importance(spark, prep, gbt))
    if out is not None:
        stamp = stamp or writers.run_stamp()
        run.paths = {"predictions": writers.write_run(run.aligned, f"{out}/predictions", stamp),
                     "metrics": f"{out}/metrics", "models": f"{out}/models/run={stamp}"}
        writers.append_metrics(run.metrics, run.paths["metrics"], stamp)
        save_models(run.paths["models"], prep, gbt, seq_model, length)
    return run
