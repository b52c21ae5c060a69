"""Streams against their batch forms, and the learning keys."""

import pytest
from pyspark.sql import functions as F

from pricelab.plans import fixtures as fx
from pricelab.plans import forecast as fc
from pricelab.session import scratch_path
from pricelab.sources import feeds
from pricelab.streaming import streams

from conftest import SF_SMALL


def test_weather_stream_equals_batch(spark):
    root = scratch_path(spark, "t_weather")
    streams.land_json(fx.weather_docs(spark, SF_SMALL).repartition(3), f"{root}/in")
    solar = feeds.solar_total(fx.generation_docs(spark, SF_SMALL))
    records, rejected = streams.weather_stream(spark, f"{root}/in", solar)
    q = streams.start_to_parquet(records, f"{root}/out", f"{root}/ck")
    q.awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    ok, _ = feeds.weather_guard(feeds.weather_flatten(fx.weather_docs(spark, SF_SMALL), keep=["doc_id", "observed_at"]))
    want = feeds.weather_record(ok, solar, time_col="observed_at")
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_maintained_solar_table_and_replay_safe_records(spark):
    root = scratch_path(spark, "t_weather2")
    gen = fx.generation_docs(spark, SF_SMALL)
    # two landings: the second adds documents to days already in the table
    gen.where("doc_id % 2 = 0").select("json").write.text(f"{root}/gen/a")
    q = streams.solar_totals_stream(spark, f"{root}/gen/*", f"{root}/solar", f"{root}/ck_s")
    q.awaitTermination()
    gen.where("doc_id % 2 = 1").select("json").write.text(f"{root}/gen/b")
    q = streams.solar_totals_stream(spark, f"{root}/gen/*", f"{root}/solar", f"{root}/ck_s")
    q.awaitTermination()
    table = streams.read_solar_table(spark, f"{root}/solar")
    want_solar = feeds.solar_total(gen)
    assert table.exceptAll(want_solar.select(*table.columns)).count() == 0
    assert table.count() == want_solar.count()

    streams.land_json(fx.weather_docs(spark, SF_SMALL), f"{root}/in")
    q = streams.weather_records_stream(spark, f"{root}/in", f"{root}/solar", f"{root}/out",
                                       f"{root}/rej", f"{root}/ck_w")
    q.awaitTermination()
    got = spark.read.parquet(f"{root}/out").drop("epoch")
    ok, bad = feeds.weather_guard(feeds.weather_flatten(fx.weather_docs(spark, SF_SMALL),
                                                        keep=["doc_id", "observed_at"]))
    want = feeds.weather_record(ok, want_solar, time_col="observed_at")
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert spark.read.parquet(f"{root}/rej").count() == bad.count()


def test_tumbling_stream_equals_batch(spark):
    root = scratch_path(spark, "t_ticks")
    ticks = fx.price_ticks(spark, SF_SMALL)
    streams.land_json(ticks, f"{root}/in")
    s = streams.price_tick_stream(spark, f"{root}/in")
    agg = streams.tumbling_average_stream(s, "timestamp", "price", ["timestamp"])
    q = (agg.writeStream.format("memory").queryName("t15").outputMode("append")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT * FROM t15")
    want = streams.tumbling_average(ticks, "timestamp", "price")
    # append mode emits a window once the watermark passes it: the last hour stays open
    closed = want.where(F.col("window_end") <= got.agg(F.max("window_end")).collect()[0][0])
    assert got.count() == closed.count() > 0
    # the operators don't round; sums in another order differ in their last digits
    rounded = [*got.columns[:-1], F.round("avg_value", 6).alias("avg_value")]
    assert got.columns[-1] == "avg_value" and got.select(*rounded).exceptAll(closed.select(*rounded)).count() == 0


@pytest.fixture(scope="module")
def prepared(spark):
    feats, cols = fc.event_features(fx.table(spark, SF_SMALL, "events"), ["ts", "event_id"])
    return fc.prepare(feats, cols, "value", ["event_id"], ["ts", "event_id"]), feats, cols


def test_gbt_curve_importance_and_roundtrip(spark, prepared):
    prep, feats, cols = prepared
    model = fc.train_gbt(prep, {"maxIter": 3})
    preds = fc.gbt_predictions(prep, model)
    assert preds.count() == fx.table(spark, SF_SMALL, "events").count()
    assert len(fc.training_curve(prep, model)) == 3
    imp = fc.feature_importance(spark, prep, model).toPandas()
    assert abs(imp.share.sum() - 1) < 1e-9 and set(imp.feature) <= set(cols)

    path = scratch_path(spark, "t_models")
    fc.save_models(path, prep, model, None)
    loaded, scaler, meta = fc.load_models(spark, path)
    assert meta["feature_names"] == cols and meta["sequence_length"] == 24
    rec = feats.select("event_id", F.array(*[F.col(c).cast("double") for c in cols]).alias("features_raw"))
    scored, bad = fc.score_features(rec, loaded, scaler, cols)
    assert bad.count() == 0
    both = scored.join(preds.select("event_id", "predicted"), "event_id")
    assert both.where(F.abs(F.col("prediction") - F.col("predicted")) > 1e-9).count() == 0


def test_sequence_model_rows_and_reloaded_scoring(spark, prepared):
    prep, _, cols = prepared
    model, seqs = fc.train_sequence(prep)
    n = fx.table(spark, SF_SMALL, "events").count()
    n_train = int(n * 0.8)
    assert seqs.count() == (n_train - 24) + (n - n_train - 24)
    assert model.numFeatures == 24 * len(prep.feature_cols)

    path = scratch_path(spark, "t_seq_models")
    fc.save_models(path, prep, fc.train_gbt(prep, {"maxIter": 2}), model)
    loaded = fc.load_sequence_model(spark, path)
    _, scaler, meta = fc.load_models(spark, path)
    rec = prep.frame.select("event_id", "split", "split_pos", F.col("xraw").alias("features_raw"))
    scored, rejected = fc.score_sequence(rec, loaded, scaler, meta["feature_names"], "split_pos", partition_cols=["split"])
    assert rejected.count() == 0
    direct = fc.sequence_predictions(prep, model, seqs)
    both = scored.join(direct.select("event_id", "predicted"), "event_id")
    assert both.count() == direct.count() == scored.count()
    assert both.where(F.abs(F.col("prediction") - F.col("predicted")) > 1e-6).count() == 0

    # spoiled lists: the same rows are scored and rejected however the blocks are cut
    width = len(cols)
    spoiled = rec.withColumn("features_raw", F.when(F.col("event_id") % 11 == 0, F.slice("features_raw", 1, width - 1))
                             .when(F.col("event_id") % 23 != 0, F.col("features_raw")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    counts = set()
    for parts in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        ok, bad = fc.score_sequence(spoiled, loaded, scaler, meta["feature_names"], "split_pos", partition_cols=["split"])
        counts.add((ok.count(), bad.count()))
        tree_ok, tree_bad = fc.score_features(spoiled, fc.load_models(spark, path)[0], scaler, meta["feature_names"])
        assert tree_ok.count() + tree_bad.count() == n and tree_bad.count() > 0
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(counts) == 1 and sum(counts.pop()) == direct.count()


def test_windows_skip_gaps(spark):
    from pricelab.operators import series

    df = spark.range(400).where("id % 11 <> 0").select(F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    sizes = {series.sequence_windows(df, ["v"], "v", length=5, block_rows=b).count() for b in (5, 64, 1000)}
    assert sizes == {sum(all((p - k) % 11 for k in range(1, 6)) and p >= 6 for p in range(400) if p % 11)}


def test_readme_flow_on_orders(spark):
    from pricelab.operators import encode, metrics
    from pricelab.plans.cleaning import clean_prices

    orders = fx.table(spark, SF_SMALL, "orders")
    clean, roles = clean_prices(orders, impute_exclude=["o_orderkey", "o_custkey"])
    assert roles["time_col"] == "o_orderdate" and roles["price_col"] == "o_totalprice"
    clean, vocab = encode.one_hot(clean, roles["categorical"])
    feats = fc.feature_columns(clean, roles["price_col"], exclude=["o_orderkey"])
    assert "o_totalprice" not in feats and "o_orderdate" not in feats and "month" in feats
    prep = fc.prepare(clean, feats, roles["price_col"], ["o_orderkey"], ["o_orderdate", "o_orderkey"])
    tree = fc.train_gbt(prep, {"maxIter": 2})
    seq, windows = fc.train_sequence(prep)
    preds = fc.gbt_predictions(prep, tree).unionByName(fc.sequence_predictions(prep, seq, windows))
    table = metrics.metric_table(metrics.regression_metrics(preds), ["tree", "sequence"]).collect()
    assert len(table) == 6 and all(r.tree is not None and r.sequence is not None for r in table)
