"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key
of the operator inventory, run over the whole driver tables.

Table mapping: ``orders`` is the price table for the cleaning and profile
keys (price ``o_totalprice``, time ``o_orderdate``); ``events`` carries the
series keys (time ``ts``, key ``event_id``, value ``value``) and the feed
documents; ``lineitem`` with two stand-in predictors carries the prediction
keys. Doubles are rounded in the output so the oracle comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.functions import calendar as cal
from pricelab.functions.names import clean_names
from pricelab.operators import encode, metrics, profiles, series, stats
from pricelab.plans import fixtures as fx
from pricelab.plans.cleaning import clean_prices
from pricelab.plans.model_keys import MODEL_KEYS
from pricelab.session import scratch_path
from pricelab.sinks.writers import append_metrics, publish, read_published, write_clean, write_run
from pricelab.sources import feeds, predictions, prices

ORDER_EVENTS = ["ts", "event_id"]
MODELS = ["tree", "sequence"]
# Messy header names used to exercise name cleaning.
MESSY_ORDER_NAMES = [" O_OrderKey", "O CustKey ", "O.OrderStatus", "O Total.Price",
                     " O_OrderDate", "o orderpriority"]
ORDERS_CSV_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
                     "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")


def _r(c, d: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def _mean2(total: str = "total", n: str = "n"):
    """Mean of 2-decimal values as round(sum, 2) / n: the true sum is a
    multiple of 0.01, so the rounding never sits on a tie and both engines
    divide the same two numbers (rounding the mean itself can land on a tie
    that float summation order then decides)."""
    return F.round(F.col(total), 2) / F.col(n)


# ------------------------------------------------------------------ sources

def q_scan_prices(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders")
    path = scratch_path(spark, "orders_csv")
    orders.write.option("header", "true").csv(path)
    return prices.scan_prices(spark, path, schema=ORDERS_CSV_SCHEMA)


def q_union_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks = separate CSV folders of the price table (one per order
    status); their union is one multi-path (globbed) scan."""
    orders = fx.table(spark, sf, "orders")
    base = scratch_path(spark, "orders_chunks")
    chunk = F.coalesce(F.col("o_orderstatus"), F.lit("none"))
    orders.withColumn("chunk", chunk).write.option("header", "true").partitionBy("chunk").csv(base)
    return prices.scan_chunks(spark, [f"{base}/chunk=*"], schema=ORDERS_CSV_SCHEMA)


def _orders_clean(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders")
    clean, _ = clean_prices(orders, time_col="o_orderdate", price_col="o_totalprice",
                            impute_exclude=["o_orderkey", "o_custkey"])
    return clean


def q_clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return clean_names(fx.table(spark, sf, "orders").toDF(*MESSY_ORDER_NAMES))


def _orders_spoiled_times(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders")
    txt = F.when(F.col("o_orderkey") % fx.SPOILED_TIME_MOD == 0, F.lit("not a date")) \
        .otherwise(F.col("o_orderdate").cast("string"))
    return o.select("o_orderkey", txt.alias("o_orderdate"))


def q_parse_times(spark: SparkSession, sf: str) -> DataFrame:
    return cal.parse_times(_orders_spoiled_times(spark, sf))


def q_calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    x = cal.add_calendar_features(q_parse_times(spark, sf), "o_orderdate")
    return x.select("o_orderkey", "day_of_week", "month", "year", "hour_of_day", "is_weekend")


def q_clean_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaning run on dirty data: an explicit time column whose name says nothing of time, two time
    formats and bad times, missing numbers and categories, NaN, and outliers."""
    clean, roles = clean_prices(fx.dirty_events(spark, sf), time_col="seen_at", price_col="value",
                                impute_exclude=["event_id"], time_formats=["dd/MM/yyyy HH:mm"])
    return clean.select("event_id", "seen_at", "user_id", "event_type", _r("value").alias("value"), "day_of_week",
                        "month", "hour_of_day", F.lit(roles["unparsed_times"]).cast("long").alias("unparsed_times"))


def q_clean_store(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the clean table written by year and month, read back."""
    path = scratch_path(spark, "clean")
    write_clean(_orders_clean(spark, sf), path)
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", "year", "month")


def q_clean_published(spark: SparkSession, sf: str) -> DataFrame:
    """K1 for readers: a first version holds half of the clean table, a second one all of it; what is current is read,
    and so is the first version, which a reader held while the second was published (``version``)."""
    base, clean = scratch_path(spark, "published"), _orders_clean(spark, sf)
    publish(clean.where("o_orderkey % 2 = 0"), base)
    held = read_published(spark, base)
    publish(clean, base)
    cols = ["o_orderkey", "o_totalprice", "year", "month"]
    return held.select(F.lit(1).alias("version"), *cols).unionByName(read_published(spark, base).select(F.lit(2).alias("version"), *cols))


def q_metric_store(spark: SparkSession, sf: str) -> DataFrame:
    """K3: the metric table stored under two runs, the first one twice, read back."""
    path, table = scratch_path(spark, "metrics"), metrics.metric_long(_metrics(spark, sf))
    for run in ("first", "second", "first"):
        append_metrics(table, path, run)
    return spark.read.parquet(path).select("run_id", "metric", "model", _r("value", 4).alias("value"))


# ------------------------------------------------------------------ statistics on events

def q_null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.null_profile(fx.events_with_gaps(spark, sf))


def q_impute_median(spark: SparkSession, sf: str) -> DataFrame:
    x = stats.impute_median(fx.events_with_gaps(spark, sf), ["user_id", "value"])
    return x.select("event_id", "user_id", _r("value").alias("value"))


def q_impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    x = stats.impute_mode(fx.events_with_gaps(spark, sf), ["event_type"])
    return x.select("event_id", "event_type")


def q_iqr_bounds(spark: SparkSession, sf: str) -> DataFrame:
    b = stats.iqr_bounds(fx.table(spark, sf, "events"), "value")
    return b.select(*[_r(c).alias(c) for c in b.columns])


def q_iqr_filter(spark: SparkSession, sf: str) -> DataFrame:
    return stats.iqr_filter(fx.table(spark, sf, "events"), "value")


def q_outlier_report(spark: SparkSession, sf: str) -> DataFrame:
    r = stats.outlier_report(fx.table(spark, sf, "events"), "value")
    return r.select("before", "after", "removed", _r("removed_share").alias("removed_share"))


def q_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = encode.one_hot(fx.events_with_gaps(spark, sf).select("event_id", "event_type"), ["event_type"])
    return x


def q_one_hot_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as categories (thousands of them), fitted on the orders of even keys and applied to all: (order, slot,
    value) of the sparse vectors; customers that weren't seen share the last slot."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    _, model = encode.one_hot_vector(orders.where("o_orderkey % 2 = 0"), "customer")
    x, _ = encode.one_hot_vector(orders, "customer", model=model)
    return encode.one_hot_long(x, "customer_vec", ["o_orderkey"])


def q_price_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = profiles.histogram(fx.table(spark, sf, "events"), "value")
    return h.select("bin", _r("bin_start").alias("bin_start"), _r("bin_end").alias("bin_end"), "count")


# ------------------------------------------------------------------ profiles on orders

def q_monthly_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = profiles.monthly_profile(_orders_clean(spark, sf), "o_totalprice")
    return p.select("month", _mean2().alias("avg_price"), "n")


def q_weekday_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = profiles.weekday_profile(_orders_clean(spark, sf), "o_totalprice")
    return p.select("day_of_week", "day_name", _mean2().alias("avg_price"), "n")


def q_price_series(spark: SparkSession, sf: str) -> DataFrame:
    s = profiles.price_series(_orders_clean(spark, sf), "o_orderdate", "o_totalprice", unit="month")
    return s.select("bucket_start", "n", _mean2().alias("avg_price"),
                    "min_price", "max_price")


# ------------------------------------------------------------------ series on events

def q_row_position(spark: SparkSession, sf: str) -> DataFrame:
    return series.with_row_position(fx.table(spark, sf, "events"), ORDER_EVENTS).select("event_id", "pos")


def _events_split(spark: SparkSession, sf: str) -> DataFrame:
    return series.chronological_split(fx.table(spark, sf, "events"), ORDER_EVENTS)


def q_chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    return _events_split(spark, sf).select("event_id", "pos", "split")


def q_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return series.hash_split(fx.table(spark, sf, "events"), ["event_id"]).select("event_id", "split")


def q_split_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The chronological split's labels, and which rows have 24 rows before them in their split, without a sort."""
    x = series.split_labels(fx.table(spark, sf, "events"), ORDER_EVENTS, preceded_by=fx.SEQUENCE_LENGTH)
    return x.select("event_id", "split", "preceded")


def q_validation_split(spark: SparkSession, sf: str) -> DataFrame:
    return series.validation_split(fx.table(spark, sf, "events"), ORDER_EVENTS).select("event_id", "split")


def q_sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = _events_split(spark, sf)
    w = series.sequence_windows(s, ["value", "user_id"], "value", length=fx.SEQUENCE_LENGTH,
                                pos_col="split_pos", partition_cols=["split"])
    seq = F.col("sequence")
    return w.select(
        "event_id", "split", F.col("value").alias("target"),
        F.size(seq).alias("seq_len"),
        F.get(F.get(seq, 0), 0).alias("first_value"),
        F.get(F.element_at(seq, -1), 0).alias("last_value"),
        _r(F.aggregate(seq, F.lit(0.0), lambda acc, r: acc + F.get(r, 0))).alias("sum_value"),
        _r(F.aggregate(seq, F.lit(0.0), lambda acc, r: acc + F.get(r, 1))).alias("sum_user"))


def q_lag_features(spark: SparkSession, sf: str) -> DataFrame:
    p = series.with_row_position(fx.table(spark, sf, "events"), ORDER_EVENTS)
    x = series.lag_features(p, ["value"], [1, 2, 3])
    return x.select("event_id", "value_lag1", "value_lag2", "value_lag3")


def q_standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = _events_split(spark, sf)
    cols = ["value", "user_id"]
    scaler = stats.fit_standard_scaler(s.where(F.col("split") == "train"), cols)
    x = stats.apply_standard_scaler(s, scaler, cols, suffix="_scaled")
    return x.select("event_id", "split", _r("value_scaled").alias("value_scaled"),
                    _r("user_id_scaled").alias("user_id_scaled"))


def q_tumbling_15m(spark: SparkSession, sf: str) -> DataFrame:
    from pricelab.streaming.streams import tumbling_average
    w = tumbling_average(fx.table(spark, sf, "events"), "ts", "value")
    return w.withColumn("avg_value", _r("avg_value"))


# ------------------------------------------------------------------ predictions on lineitem

def q_prediction_errors(spark: SparkSession, sf: str) -> DataFrame:
    p = metrics.with_errors(fx.lineitem_predictions(spark, sf))
    return p.select(*fx.LINEITEM_KEY, "model", _r("error", 4).alias("error"))


def q_stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The predictions stored as a CSV run in wide form (one model's error column left out), read back by its header."""
    base = scratch_path(spark, "stored_predictions")
    wide = predictions.to_wide(fx.lineitem_wide(spark, sf), "price", MODELS, errors=["tree"])
    write_run(wide, base, stamp="20250101_000000", fmt="csv")
    x = predictions.read_run(spark, base)
    kinds = dict(fx.table(spark, sf, "lineitem").dtypes)
    return x.select(*[F.col(c).cast(kinds[c]) for c in fx.LINEITEM_KEY], "model", _r("error", 4).alias("error"))


def q_union_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """U1 by frames: the chunks of the price table as separate frames, one of them without the priority column."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    parts = [orders.where(F.col("o_orderkey") % 3 == i) for i in range(3)]
    return prices.union_prices([parts[0], parts[1].drop("o_orderpriority"), parts[2]], allow_missing=True)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regression_metrics(fx.lineitem_predictions(spark, sf))


def q_regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    return m.select("model", "split", "n", _r("rmse", 4).alias("rmse"), _r("mae", 4).alias("mae"),
                    _r("mse", 0).alias("mse"), _r("r2", 6).alias("r2"))


def q_metric_table(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metric_table(_metrics(spark, sf), MODELS)


def q_metric_long(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison written as text (as the files hold it), parsed back."""
    t = metrics.metric_long(_metrics(spark, sf)).withColumn("text", metrics.format_metric(F.col("value")))
    return t.select("metric", "model", metrics.parse_metric(F.col("text")).alias("value"))


def q_model_winner(spark: SparkSession, sf: str) -> DataFrame:
    w = metrics.model_winner(_metrics(spark, sf), ("tree", "sequence"))
    return w.select("winner", _r("tree_test_rmse", 4).alias("tree_test_rmse"),
                    _r("sequence_test_rmse", 4).alias("sequence_test_rmse"))


def q_prediction_series(spark: SparkSession, sf: str) -> DataFrame:
    s = profiles.prediction_series(fx.lineitem_predictions(spark, sf), "ts", unit="month")
    return s.select("bucket_start", "series", _mean2().alias("avg_value"), "n")


def q_error_density(spark: SparkSession, sf: str) -> DataFrame:
    p = metrics.with_errors(fx.lineitem_predictions(spark, sf))
    d = profiles.kernel_density(p, "error", group_col="model")
    return d.select("model", "grid_i", _r("x", 6).alias("x"), _r("density", 12).alias("density"))


def q_residual_bins(spark: SparkSession, sf: str) -> DataFrame:
    r = profiles.residual_bins(fx.lineitem_predictions(spark, sf))
    return r.select("model", "pred_bin", "resid_bin", "n", _r("pred_centre", 4).alias("pred_centre"),
                    _r("resid_centre", 4).alias("resid_centre"))


def q_recent_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.lineitem_predictions(spark, sf).where(F.col("model") == "tree")
    r = metrics.recent_predictions(p, "ts", n=20, tie_break=fx.LINEITEM_KEY)
    return r.select(*fx.LINEITEM_KEY, "ts", "actual", "predicted")


def q_aligned_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.lineitem_predictions(spark, sf).where(F.col("split") == "test")
    actual = p.where(F.col("model") == "tree").select(*fx.LINEITEM_KEY, "ts", "actual")
    preds = {m: p.where(F.col("model") == m).select(*fx.LINEITEM_KEY, "predicted") for m in MODELS}
    a = metrics.aligned_predictions(actual, preds, fx.LINEITEM_KEY)
    return a.select(*fx.LINEITEM_KEY, "ts", "actual", "tree_predicted", "sequence_predicted",
                    _r("tree_error", 4).alias("tree_error"), _r("sequence_error", 4).alias("sequence_error"))


# ------------------------------------------------------------------ feeds

def _weather(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.weather_flatten(fx.weather_docs(spark, sf), keep=["doc_id", "observed_at"])


def q_weather_flatten(spark: SparkSession, sf: str) -> DataFrame:
    w = _weather(spark, sf)
    return w.select("doc_id", *[_r(c).alias(c) for c in ("temperature", "wind_speed", "cloud_cover",
                                                          "humidity", "precipitation", "solar_estimate_kw")])


def q_solar_estimate(spark: SparkSession, sf: str) -> DataFrame:
    w = _weather(spark, sf)
    return w.select("doc_id", "cloud_cover", _r("solar_estimate_kw").alias("solar_kw"))


def q_solar_total(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.solar_total(fx.generation_docs(spark, sf))


def q_weather_guard(spark: SparkSession, sf: str) -> DataFrame:
    tagged = feeds.weather_status(_weather(spark, sf))
    return tagged.select("doc_id", "status", _r("temperature").alias("temperature"))


def q_weather_record(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = feeds.weather_guard(_weather(spark, sf))
    solar = feeds.solar_total(fx.generation_docs(spark, sf))
    r = feeds.weather_record(ok, solar, time_col="observed_at")
    return r.select("timestamp", "doc_id", _r("temperature").alias("temperature"),
                    _r("wind_speed").alias("wind_speed"), "humidity", "cloud_coverage", "solar_generation")


def q_carbon_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.carbon_intensity(fx.carbon_docs(spark, sf), keep=["doc_id"])


def q_grid_load_xml(spark: SparkSession, sf: str) -> DataFrame:
    g = feeds.grid_load(fx.load_docs(spark, sf), keep=["doc_id"])
    return g.select("doc_id", F.col("pos").cast("long").alias("pos"), "load_ts",
                    _r("grid_demand_mw").alias("grid_demand_mw"))


def q_grid_load_latest(spark: SparkSession, sf: str) -> DataFrame:
    g = feeds.grid_load_latest(fx.load_docs(spark, sf), keep=["doc_id"])
    return g.select("doc_id", "load_ts", _r("grid_demand_mw").alias("grid_demand_mw"))


BATCH_KEYS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "monthly_profile": q_monthly_profile,
    "scan_prices": q_scan_prices,
    "union_prices": q_union_prices,
    "clean_names": q_clean_names,
    "parse_times": q_parse_times,
    "calendar_features": q_calendar_features,
    "clean_run": q_clean_run,
    "clean_store": q_clean_store,
    "clean_published": q_clean_published,
    "metric_store": q_metric_store,
    "null_profile": q_null_profile,
    "impute_median": q_impute_median,
    "impute_mode": q_impute_mode,
    "iqr_bounds": q_iqr_bounds,
    "iqr_filter": q_iqr_filter,
    "outlier_report": q_outlier_report,
    "one_hot": q_one_hot,
    "one_hot_wide": q_one_hot_wide,
    "price_histogram": q_price_histogram,
    "weekday_profile": q_weekday_profile,
    "price_series": q_price_series,
    "row_position": q_row_position,
    "chronological_split": q_chronological_split,
    "split_labels": q_split_labels,
    "hash_split": q_hash_split,
    "validation_split": q_validation_split,
    "sequence_windows": q_sequence_windows,
    "lag_features": q_lag_features,
    "standard_scale": q_standard_scale,
    "tumbling_15m": q_tumbling_15m,
    "prediction_errors": q_prediction_errors,
    "stored_predictions": q_stored_predictions,
    "union_chunks": q_union_chunks,
    "regression_metrics": q_regression_metrics,
    "metric_table": q_metric_table,
    "metric_long": q_metric_long,
    "model_winner": q_model_winner,
    "prediction_series": q_prediction_series,
    "error_density": q_error_density,
    "residual_bins": q_residual_bins,
    "recent_predictions": q_recent_predictions,
    "aligned_predictions": q_aligned_predictions,
    "weather_flatten": q_weather_flatten,
    "solar_estimate": q_solar_estimate,
    "solar_total": q_solar_total,
    "weather_guard": q_weather_guard,
    "weather_record": q_weather_record,
    "carbon_intensity": q_carbon_intensity,
    "grid_load_xml": q_grid_load_xml,
    "grid_load_latest": q_grid_load_latest,
}


ALL_KEYS = {**BATCH_KEYS, **MODEL_KEYS}
