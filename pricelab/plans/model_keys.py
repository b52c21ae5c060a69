"""Registered keys that train, store or stream: model training and scoring,
model persistence, latest-run scans and the streaming jobs.

A model's numbers have no SQL form, so the model keys return what SQL can say
about them: which rows get a prediction, with which actual value, and checks
computed here from the predictions (each named in the key's docstring). Each
key trains the full 100 trees and reads the driver tables (``events`` /
``lineitem``), so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelab.plans import fixtures as fx
from pricelab.plans import forecast as fc
from pricelab.plans import forecaster as fo
from pricelab.session import scratch_path, small_frame
from pricelab.sinks.writers import write_run
from pricelab.sources import feeds, prices
from pricelab.streaming import streams

KEY = ["event_id"]
ORDER = ["ts", "event_id"]
# Events whose feature list is spoiled to exercise the guard.
SPOILED_WIDTH_MOD = 11
MISSING_LIST_MOD = 23
MISSING_VALUE_MOD = 37
UNSEEN_MOD = 7
TRUNCATED_MOD = 37


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    return fc.event_features(fx.table(spark, sf, "events"), ORDER)


def _prepared(spark: SparkSession, sf: str, feats=None) -> fc.Prepared:
    feats, cols = feats or _features(spark, sf)
    return fc.prepare(feats, cols, "value", KEY, ORDER)


def _is_number(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def _checked(preds: DataFrame) -> DataFrame:
    """event_id, split, actual, scored (the prediction is a number) and fits_train (over the train rows the
    squared error is at most that of their mean)."""
    train = preds.where(F.col("split") == "train").agg(
        (F.avg((F.col("actual") - F.col("predicted")) ** 2) <= F.var_pop("actual") * (1 + 1e-9)).alias("fits_train"))
    return (preds.crossJoin(F.broadcast(train))
            .select("event_id", "split", "actual", _is_number("predicted").alias("scored"), "fits_train"))


def q_gbt_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with its split, its actual value and the checks of :func:`_checked`."""
    prep = _prepared(spark, sf)
    model = fc.train_gbt(prep)
    return _checked(fc.gbt_predictions(prep, model))


def q_sequence_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The events with 24 predecessors in their split, as :func:`q_gbt_forecast`."""
    prep = _prepared(spark, sf)
    model, seqs = fc.train_sequence(prep)
    return _checked(fc.sequence_predictions(prep, model, seqs))


def q_training_curve(spark: SparkSession, sf: str) -> DataFrame:
    """One row per tree: its number, and whether its validation loss is a number of at least 0."""
    prep = _prepared(spark, sf)
    model = fc.train_gbt(prep)
    curve = small_frame(spark, fc.training_curve(prep, model), "iteration int, validation_mse double")
    return curve.select("iteration", (_is_number("validation_mse") & (F.col("validation_mse") >= 0)).alias("has_loss"))


def q_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The features by name, whether each importance is at least 0, and whether all shares sum to 1."""
    prep = _prepared(spark, sf)
    model = fc.train_gbt(prep)
    top = fc.feature_importance(spark, prep, model, top=20)
    total = top.agg((F.abs(F.sum("share") - 1) < 1e-6).alias("shares_sum_to_one"))
    return (top.crossJoin(F.broadcast(total))
            .select("feature", (F.col("importance") >= 0).alias("not_negative"), "shares_sum_to_one"))


def q_gain_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The features by gain (top 15), whether a feature has gain just where it has splits, and whether gains fall."""
    prep = _prepared(spark, sf)
    top = fc.gain_importance(fc.train_gbt(prep), prep.feature_cols)
    above = F.lag("gain").over(Window.orderBy(F.col("gain").desc(), "feature"))  # 15 rows
    return top.select("feature", ((F.col("gain") > 0) == (F.col("splits") > 0)).alias("consistent"),
                      (F.coalesce(above, F.col("gain")) >= F.col("gain")).alias("falling"))


def _raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows for scoring: gaps, categories that the run hasn't seen, numbers as text, and rows without a time."""
    k = F.col("event_id")
    return fx.events_with_gaps(spark, sf).select(
        "event_id", F.when(k % fx.SPOILED_TIME_MOD != 0, F.col("ts")).alias("ts"),
        F.when(k % UNSEEN_MOD == 0, F.lit("not seen")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % MISSING_LIST_MOD == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("user_id"))


def _fitted(spark: SparkSession, sf: str, by_type: bool) -> fo.Forecaster:
    """A run on the raw events, stored and loaded."""
    events = fx.events_with_gaps(spark, sf)
    run, _ = fo.fit(events, "value", KEY, "ts", series_cols=["event_type"] if by_type else None, numeric=["user_id"], categorical=["event_type"])
    return run


def _reloaded(spark: SparkSession, run: fo.Forecaster) -> fo.Forecaster:
    path = scratch_path(spark, "forecaster")
    fo.save(run, path)
    return fo.load(spark, path)


def _scores_beside(scores: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Statuses, which predictions are numbers, and whether both are those of ``other`` (missing where that has none)."""
    def same(c: str):
        a, b = F.col(c), F.col(f"o_{c}")
        return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= 1e-6 * (1 + F.abs(b)), F.lit(False))

    kept = [F.col(c).alias(f"o_{c}") for c in ("tree_predicted", "sequence_predicted")]
    x = scores.join(other.select("event_id", *kept), "event_id")
    return x.select("event_id", "tree_status", "sequence_status", _is_number("tree_predicted").alias("has_tree"),
                    _is_number("sequence_predicted").alias("has_sequence"), (same("tree_predicted") & same("sequence_predicted")).alias(name))


def q_score_raw(spark: SparkSession, sf: str) -> DataFrame:
    """S9/M6 on raw rows: a stored run scores every event by both models; ``as_fitted``: as the run before it was stored."""
    run, raw = _fitted(spark, sf, by_type=False), _raw_events(spark, sf)
    return _scores_beside(fo.score(_reloaded(spark, run), raw), fo.score(run, raw), "as_fitted")


def q_stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    """S9/M6 on a stream: the events land in four parts by time and are scored by a stored run, a series per event
    type, the stream being started anew for each; ``as_batch``: as one batch over all."""
    run, raw = _reloaded(spark, _fitted(spark, sf, by_type=True)), _raw_events(spark, sf)
    root = scratch_path(spark, "score_stream")
    span = raw.agg(F.min("ts").alias("__from"), F.max("ts").alias("__to"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("__from").cast("timestamp"))
    whole = F.unix_seconds(F.col("__to").cast("timestamp")) - F.unix_seconds(F.col("__from").cast("timestamp")) + 1
    parts = raw.crossJoin(F.broadcast(span)).withColumn("__part", F.coalesce((seconds * 4 / whole).cast("int"), F.lit(0)))
    for i in range(4):
        parts.where(F.col("__part") == i).select(*raw.columns).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(raw.schema).parquet(f"{root}/in")
        fo.score_stream(run, stream, f"{root}/out", f"{root}/ckpt", tail_epochs=2).awaitTermination()
    return _scores_beside(spark.read.parquet(f"{root}/out"), fo.score(run, raw), "as_batch")


def _raw_feature_records(prep: fc.Prepared) -> DataFrame:
    """Raw feature lists per event, read from the checkpointed prepared frame; some lose their last value,
    some hold a missing value and some are missing, to exercise the guard."""
    arr, k = F.col("xraw"), F.col("event_id")
    n = len(prep.feature_cols)
    gap = F.concat(F.slice(arr, 1, n - 1), F.array(F.lit(None).cast("double")))
    spoiled = (F.when(k % SPOILED_WIDTH_MOD == 0, F.slice(arr, 1, n - 1)).when(k % MISSING_LIST_MOD == 0, F.lit(None))
               .when(k % MISSING_VALUE_MOD == 0, gap).otherwise(arr))
    return prep.frame.select("event_id", "split", "split_pos", spoiled.alias("features_raw"))


def q_score_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every event: scored or rejected, and whether it has a prediction."""
    prep = _prepared(spark, sf)
    model = fc.train_gbt(prep)
    scored, bad = fc.score_features(_raw_feature_records(prep), model, prep.scaler, prep.feature_cols)
    return scored.select("event_id", F.lit("scored").alias("status"), _is_number("prediction").alias("has_prediction")) \
        .unionByName(bad.select("event_id", F.lit("rejected").alias("status"), F.lit(False).alias("has_prediction")))


def q_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Both models stored, loaded and applied to records with spoiled lists: which rows each scores or rejects, and
    whether a stored model's prediction is the fitted one's (where both saw the same good lists)."""
    prep = _prepared(spark, sf)
    gbt = fc.train_gbt(prep)
    seq, seqs = fc.train_sequence(prep)
    path = scratch_path(spark, "models")
    fc.save_models(path, prep, gbt, seq)
    loaded, scaler, meta = fc.load_models(spark, path)
    loaded_seq = fc.load_sequence_model(spark, path)
    records = _raw_feature_records(prep)
    tree, tree_bad = fc.score_features(records, loaded, scaler, meta["feature_names"])
    in_window, window_bad = fc.score_sequence(records, loaded_seq, scaler, meta["feature_names"], "split_pos",
                                              meta["sequence_length"], partition_cols=["split"])
    fitted = fc.gbt_predictions(prep, gbt).unionByName(fc.sequence_predictions(prep, seq, seqs)) \
        .select("event_id", "model", F.col("predicted").alias("fitted"))
    scored = tree.select("event_id", F.lit("tree").alias("model"), "prediction") \
        .unionByName(in_window.select("event_id", F.lit("sequence").alias("model"), "prediction")) \
        .join(fitted, ["event_id", "model"])
    same = F.abs(F.col("prediction") - F.col("fitted")) <= 1e-6 * (1 + F.abs(F.col("fitted")))
    rejected = tree_bad.select("event_id", F.lit("tree").alias("model")).unionByName(
        window_bad.select("event_id", F.lit("sequence").alias("model")))
    return scored.select("event_id", "model", F.lit("scored").alias("status"), same.alias("as_fitted")) \
        .unionByName(rejected.select("event_id", "model", F.lit("rejected").alias("status"), F.lit(None).cast("boolean").alias("as_fitted")))


def q_forecast_run(spark: SparkSession, sf: str) -> DataFrame:
    """M7: the whole run with its writes, read back: the stored metric table (names, models, whether each value is
    a number), the aligned rows that were stored, and whether the stored models load with the run's features."""
    feats, cols = _features(spark, sf)
    run = fc.run_forecast(feats, cols, "value", KEY, ORDER, out=scratch_path(spark, "forecast"))
    stored = spark.read.parquet(run.paths["metrics"])
    rows = spark.read.parquet(run.paths["predictions"]).agg(F.count("*").alias("aligned_rows"))
    _, _, meta = fc.load_models(spark, run.paths["models"])
    return (stored.crossJoin(F.broadcast(rows))
            .select("metric", "model", _is_number("value").alias("has_value"), "aligned_rows",
                    F.lit(meta["feature_names"] == cols).alias("models_load")))


def q_latest_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two run-stamped prediction writes; only the newest run is scanned."""
    p = fx.lineitem_predictions(spark, sf, positions=True)
    base = scratch_path(spark, "predictions")
    write_run(p.where(F.col("model") == "sequence"), base, stamp="20250101_000000")
    write_run(p.where(F.col("model") == "tree"), base, stamp="20250101_000001")
    return spark.read.parquet(prices.latest_run(spark, base, "*.parquet"))


def q_stream_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Landed generation documents keep a per-day solar table current
    (stateful stream); landed weather documents are flattened, guarded and
    joined with that table per micro-batch; records and rejects land in
    replay-safe per-epoch folders."""
    root = scratch_path(spark, "weather_stream")
    fx.generation_docs(spark, sf).select("json").write.text(f"{root}/gen_in")
    streams.land_json(fx.weather_docs(spark, sf), f"{root}/in")
    q1 = streams.solar_totals_stream(spark, f"{root}/gen_in", f"{root}/solar", f"{root}/ckpt_solar")
    q1.awaitTermination()
    q2 = streams.weather_records_stream(spark, f"{root}/in", f"{root}/solar", f"{root}/out",
                                        f"{root}/rejected", f"{root}/ckpt_weather")
    q2.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("epoch")


def q_stream_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """R1 with faults: a part of the weather documents is cut short, and every batch's first attempt fails; where each
    document ends up (record, rejected or malformed)."""
    root = scratch_path(spark, "weather_faults")
    docs = fx.weather_docs(spark, sf)
    cut = F.when(F.col("doc_id") % TRUNCATED_MOD == 0, F.expr("left(json, length(json) - 1)")).otherwise(F.col("json"))
    streams.land_json(docs.withColumn("json", cut), f"{root}/in")
    seen: set[int] = set()

    def fails_once(batch: DataFrame, epoch: int) -> None:
        if epoch not in seen:
            seen.add(epoch)
            raise RuntimeError("service not reachable")

    streams.supervise(lambda: streams.weather_records_stream(
        spark, f"{root}/in", f"{root}/solar", f"{root}/out", f"{root}/rejected", f"{root}/ckpt", dead_path=f"{root}/dead", before_batch=fails_once))
    ends = {"record": f"{root}/out", "rejected": f"{root}/rejected", "malformed": f"{root}/dead/documents"}
    failures = spark.read.parquet(f"{root}/dead/failures").agg(F.count_distinct("epoch").alias("n"), F.max("attempt").alias("m"))
    logged = failures.select(((F.col("n") > 0) & (F.col("m") == 1)).alias("failures_logged"))
    rows = [spark.read.parquet(p).select("doc_id", F.lit(k).alias("status")) for k, p in ends.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).crossJoin(F.broadcast(logged))


def q_solar_total_table(spark: SparkSession, sf: str) -> DataFrame:
    """generation documents land in a table partitioned by settlement day, which answers for every day."""
    root = scratch_path(spark, "generation_table")
    fx.generation_docs(spark, sf).select("json").write.text(f"{root}/in")
    streams.generation_table_stream(spark, f"{root}/in", f"{root}/table", f"{root}/ckpt").awaitTermination()
    return streams.solar_total_of_table(spark.read.parquet(f"{root}/table"))


def q_tumbling_stream(spark: SparkSession, sf: str) -> DataFrame:
    """R3 on a stream: the events land in time order, in two parts that share a few events (sent twice); the watermark closes
    the windows that it has passed, duplicates count once."""
    root = scratch_path(spark, "tumbling")
    ev = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    half = ev.agg(F.expr("timestamp_micros(cast((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 as bigint))").alias("__half"))
    x = ev.crossJoin(F.broadcast(half))
    late = F.col("ts") >= F.col("__half")
    again = (F.col("ts") >= F.expr("__half - interval 30 minutes")) & ~late
    for part in (x.where(~late), x.where(late | again)):
        part.drop("__half").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(ev.schema).parquet(f"{root}/in")
        out = streams.tumbling_average_stream(stream, "ts", "value", ["event_id"])
        streams.start_to_parquet(out, f"{root}/out", f"{root}/ckpt").awaitTermination()
    done = spark.read.parquet(f"{root}/out")
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return done.select(*ntz, "n", F.round("avg_value", 6).alias("avg_value"))


def q_stream_prices(spark: SparkSession, sf: str) -> DataFrame:
    """R2: price ticks appended as they land."""
    root = scratch_path(spark, "price_stream")
    streams.land_json(fx.price_ticks(spark, sf), f"{root}/in")
    q = streams.start_to_parquet(streams.price_tick_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


MODEL_KEYS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gbt_forecast": q_gbt_forecast,
    "sequence_forecast": q_sequence_forecast,
    "training_curve": q_training_curve,
    "feature_importance": q_feature_importance,
    "score_features": q_score_features,
    "gain_importance": q_gain_importance,
    "score_raw": q_score_raw,
    "stream_scores": q_stream_scores,
    "model_roundtrip": q_model_roundtrip,
    "forecast_run": q_forecast_run,
    "latest_file_scan": q_latest_file_scan,
    "stream_weather": q_stream_weather,
    "stream_prices": q_stream_prices,
    "stream_dead_letters": q_stream_dead_letters,
    "solar_total_table": q_solar_total_table,
    "tumbling_stream": q_tumbling_stream,
}
