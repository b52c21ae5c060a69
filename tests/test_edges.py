"""Edge cases and golden values (§5.2)."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelab.functions import calendar as cal
from pricelab.functions.names import clean_name, clean_names, detect_roles
from pricelab.operators import encode, metrics, profiles, stats
from pricelab.plans.cleaning import clean_prices
from pricelab.session import scratch_path
from pricelab.sinks.writers import write_run
from pricelab.sources import feeds, prices


def test_all_missing_category_becomes_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, c string")
    assert [r.c for r in stats.impute_mode(df, ["c"]).collect()] == ["unknown", "unknown"]


def test_mode_ties_go_to_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "a")], "k long, c string")
    out = {r.k: r.c for r in stats.impute_mode(df, ["c"]).collect()}
    assert out[3] == "a"


def test_unparsable_time_is_null_and_not_weekend(spark):
    df = spark.createDataFrame([("2024-01-06 10:00:00",), ("garbage",)], "ts string")
    out = cal.add_calendar_features(cal.parse_times(df, ["ts"]), "ts").collect()
    assert out[0].day_of_week == 5 and out[0].is_weekend == 1 and out[0].hour_of_day == 10
    assert out[1].ts is None and out[1].day_of_week is None and out[1].is_weekend == 0


def test_calendar_guard_skips_all_missing_series(spark):
    df = spark.createDataFrame([(None,)], "ts timestamp_ntz")
    assert cal.add_calendar_features(df, "ts").columns == ["ts"]


def test_clean_names_rule_and_collisions(spark):
    assert clean_name(" Spot Price.EUR ") == "spot_price_eur"
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a.b` int")
    with pytest.raises(ValueError):
        clean_names(df)


def test_roles_follow_substring_rules(spark):
    df = spark.createDataFrame([(1, "x", 2.0, "2024-01-01")], "update_flag int, action string, price double, date_time string")
    r = detect_roles(df)
    assert r.time_col == "update_flag"  # the greedy rule: 'update' contains 'date'
    assert r.price_col == "price"
    assert detect_roles(df, time_col="date_time").time_col == "date_time"


def test_one_hot_sorted_and_missing_all_zero(spark):
    df = spark.createDataFrame([(1, "sell"), (2, "buy"), (3, None)], "k long, action string")
    out, vocab = encode.one_hot(df, ["action"])
    assert vocab == {"action": ["buy", "sell"]}
    assert out.columns == ["k", "action_buy", "action_sell"]
    assert [tuple(r)[1:] for r in out.orderBy("k").collect()] == [(0, 1), (1, 0), (0, 0)]
    with pytest.raises(ValueError):
        encode.one_hot(spark.range(10).select(F.col("id").cast("string").alias("c")), ["c"], max_categories=5)


def test_constant_target_r2(spark):
    df = spark.createDataFrame([("m", "test", 5.0, 5.0), ("m", "test", 5.0, 5.0),
                                ("w", "test", 5.0, 4.0), ("w", "test", 5.0, 6.0)],
                               "model string, split string, actual double, predicted double")
    r = {x.model: x.r2 for x in metrics.regression_metrics(df).collect()}
    assert r == {"m": 1.0, "w": 0.0}


def test_iqr_filter_inclusive_and_drops_missing(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, p double")
    kept = sorted(r.p for r in stats.iqr_filter(df, "p").collect())
    assert kept == [1.0, 2.0, 3.0, 4.0]
    rep = stats.outlier_report(df, "p").collect()[0]
    assert (rep.before, rep.after, rep.removed) == (6, 4, 2)


def test_cleaning_run_order(spark):
    rows = [(" 2024-01-0%d 0%d:00:00" % (d, d), float(p) if p is not None else None, a)
            for d, p, a in [(1, 10, "buy"), (2, None, None), (3, 12, "buy"), (4, 11, "sell"), (5, 1000, "sell")]]
    df = spark.createDataFrame(rows, "`Settlement Time` string, `Spot.Price` double, Action string")
    out, roles = clean_prices(df)
    assert roles["time_col"] == "settlement_time" and roles["price_col"] == "spot_price"
    got = sorted((r.spot_price, r.action) for r in out.collect())
    # median (11.5) fills before the outlier filter; mode fills the action
    assert got == [(10.0, "buy"), (11.0, "sell"), (11.5, "buy"), (12.0, "buy")]
    assert {"day_of_week", "month", "year", "hour_of_day", "is_weekend"} <= set(out.columns)


def test_feed_edge_cases(spark):
    w = spark.createDataFrame([(1, json.dumps({"main": {"temp": 10, "humidity": 50}, "wind": {"speed": 3},
                                                "clouds": {"all": 40}})),
                               (2, json.dumps({"main": {"humidity": 5}, "wind": {"speed": 1},
                                                "clouds": {"all": 0}, "rain": {"1h": 0.7}}))], "doc_id long, json string")
    flat = {r.doc_id: r for r in feeds.weather_flatten(w, keep=["doc_id"]).collect()}
    assert flat[1].precipitation == 0.0 and math.isclose(flat[1].solar_estimate_kw, 12.0)
    assert flat[2].precipitation == 0.7 and math.isclose(flat[2].solar_estimate_kw, 20.0)
    ok, bad = feeds.weather_guard(feeds.weather_flatten(w, keep=["doc_id"]))
    assert [r.doc_id for r in bad.collect()] == [2] and ok.count() == 1

    g = spark.createDataFrame([(json.dumps({"settlement_date": "2024-01-01", "settlement_period": 5,
                                            "data": [{"businessType": "Solar generation", "quantity": 2.9},
                                                     {"businessType": "Solar generation", "quantity": 1.2},
                                                     {"businessType": "Wind generation", "quantity": 9.0}]}),),
                               (json.dumps({"settlement_date": "2024-01-02", "settlement_period": 5}),),
                               (json.dumps({"settlement_date": "2024-01-02", "settlement_period": 48,
                                            "data": [{"businessType": "Solar generation", "quantity": 7}]}),)],
                              "json string")
    tot = {str(r.settlement_date): r.solar_generation for r in feeds.solar_total(g).collect()}
    assert tot == {"2024-01-01": 4, "2024-01-02": 0}  # 4.1 truncated; no data -> 0; period 48 excluded

    c = spark.createDataFrame([(1, '{"data": []}'),
                               (2, '{"data": [{"intensity": {"actual": 90, "forecast": 95, "index": "low"}}]}')],
                              "doc_id long, json string")
    ci = {r.doc_id: r for r in feeds.carbon_intensity(c, keep=["doc_id"]).collect()}
    assert ci[1].carbon_intensity is None and ci[2].status == "low"

    xml = ("<Publication><TimeSeries><Period><start>2024-01-01 00:00:00</start>"
           "<quantity>5</quantity><quantity>6</quantity></Period></TimeSeries>"
           "<TimeSeries><Period><start>2024-01-02 00:00:00</start><quantity>7</quantity></Period></TimeSeries>"
           "</Publication>")
    x = spark.createDataFrame([(1, xml), (2, "<Publication/>")], "doc_id long, xml string")
    rows = [(r.pos, r.grid_demand_mw) for r in feeds.grid_load(x, keep=["doc_id"]).orderBy("pos").collect()]
    assert rows == [(0, 5.0), (1, 6.0), (2, 7.0)]  # ragged: second start paired by position
    last = feeds.grid_load_latest(x, keep=["doc_id"]).collect()
    assert len(last) == 1 and last[0].grid_demand_mw == 7.0 and last[0].load_ts is None


GOLDEN = [  # golden rows: actual, tree and sequence predictions, stored errors
    (85.38846158716365, 91.0063600016441, 103.78931575808812, -5.61789841448045, -18.400854170924475),
    (86.30389933710141, 92.68333495615349, 84.59832199720856, -6.3794356190520745, 1.705577339892855),
    (94.02014155600594, 94.94291086444409, 104.29290926536372, -0.9227693084381485, -10.27276770935778),
    (104.07929875812836, 104.961418246259, 104.20343511459127, -0.8821194881306411, -0.12413635646291254),
]


def test_golden_errors_and_metrics(spark):
    long = spark.createDataFrame(
        [("tree", "test", a, t) for a, t, *_ in GOLDEN] + [("sequence", "test", a, s) for a, _, s, *_ in GOLDEN],
        "model string, split string, actual double, predicted double")
    errs = metrics.with_errors(long).where("model = 'tree'").select("error").collect()
    for r, g in zip(errs, GOLDEN):
        assert abs(r.error - g[3]) < 5e-14
    got = {r.model: r for r in metrics.regression_metrics(long).collect()}
    a = np.array([g[0] for g in GOLDEN])
    for name, idx in (("tree", 1), ("sequence", 2)):
        p = np.array([g[idx] for g in GOLDEN])
        e = a - p
        assert math.isclose(got[name].rmse, math.sqrt((e ** 2).mean()), rel_tol=1e-12)
        assert math.isclose(got[name].mae, np.abs(e).mean(), rel_tol=1e-12)
        assert math.isclose(got[name].r2, 1 - (e ** 2).sum() / ((a - a.mean()) ** 2).sum(), rel_tol=1e-9)


def test_metric_text_parses(spark):
    df = spark.createDataFrame([("-0.0006",), ("9.5641",), ("n/a",)], "t string")
    assert [r.v for r in df.select(metrics.parse_metric(F.col("t")).alias("v")).collect()] == [-0.0006, 9.5641, None]


def test_winner_tie_is_similar(spark):
    m = spark.createDataFrame([("a", "test", 1.0), ("b", "test", 1.0)], "model string, split string, rmse double")
    assert metrics.model_winner(m, ("a", "b")).collect()[0].winner == "similar"


def test_histogram_auto_bins_cover_all_rows(spark):
    rng = np.random.default_rng(0)
    xs = rng.normal(100, 20, 500).round(2)
    df = spark.createDataFrame([(float(v),) for v in xs], "p double")
    h = profiles.histogram(df, "p").toPandas()
    counts, edges = np.histogram(xs, bins="auto")
    assert h["count"].sum() == 500 and len(h) <= len(counts)
    assert h.set_index("bin")["count"].reindex(range(len(counts)), fill_value=0).tolist() == counts.tolist()


def test_latest_run_and_csv_scan(spark):
    base = scratch_path(spark, "runs")
    write_run(spark.range(3), base, stamp="20250101_000000")
    write_run(spark.range(5), base, stamp="20250101_000001")
    assert spark.read.parquet(prices.latest_run(spark, base)).count() == 5
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1, 2.5, "2024-01-01 00:00:00")], "`Row Id` int, `Price.GBP` double, `Time` string") \
        .write.option("header", "true").csv(path)
    df = prices.scan_prices(spark, path)  # inferred types, cleaned names
    assert df.columns == ["row_id", "price_gbp", "time"]
    assert df.schema["price_gbp"].dataType.simpleString() == "double"


def test_feature_projection_and_sinks(spark):
    from pricelab.plans.forecast import feature_columns
    from pricelab.sinks.writers import append_metrics, write_clean

    df = spark.createDataFrame([(1, 2.0, 3.0, None, 2024, 1)],
                               "k long, a double, price double, timestamp timestamp_ntz, year int, month int")
    assert feature_columns(df, "price", exclude=["k"]) == ["a", "year", "month"]
    with pytest.raises(ValueError):
        feature_columns(df.withColumn("s", F.lit("x")), "price")
    out = scratch_path(spark, "clean")
    write_clean(df, out)
    assert spark.read.parquet(out).count() == 1 and "year=2024" in str(spark.read.parquet(out).inputFiles())
    m = scratch_path(spark, "metrics")
    long = spark.createDataFrame([("Testing RMSE", "tree", 1.0)], "metric string, model string, value double")
    append_metrics(long, m, "r1")
    append_metrics(long, m, "r2")
    assert sorted(r.run_id for r in spark.read.parquet(m).collect()) == ["r1", "r2"]


def test_peek_strict_parse_and_approx(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k long, x double")
    cols, rows = prices.peek(df, 5)
    assert cols == ["k", "x"] and len(rows) == 5
    bad = spark.createDataFrame([("2024-01-01 00:00:00",), ("nope",)], "t string")
    with pytest.raises(Exception):
        bad.select(cal.parse_time_strict(F.col("t"))).collect()
    ok = bad.select(cal.parse_time(F.col("t")).alias("t")).collect()
    assert ok[1].t is None
    exact = stats.quantiles_by_column(df, ["x"], [0.5]).collect()[0].q0
    approx = stats.quantiles_by_column(df, ["x"], [0.5], method="approx").collect()[0].q0
    assert exact == 49.5 and abs(approx - 49.5) <= 1.0


def test_latest_file_and_text_stream(spark):
    from pricelab.streaming import streams

    base = scratch_path(spark, "files")
    spark.createDataFrame([(1,)], "a int").write.json(f"{base}/one")
    spark.createDataFrame([(2,)], "a int").write.json(f"{base}/two")
    p = prices.latest_file(spark, f"{base}/two", "*.json")
    assert p.endswith(".json") and "/two/" in p
    lines = streams.read_json_lines(spark, f"{base}/one")
    q = (lines.writeStream.format("memory").queryName("t_lines").trigger(availableNow=True)
         .option("checkpointLocation", f"{base}/ck").start())
    q.awaitTermination()
    assert [r.json for r in spark.sql("SELECT json FROM t_lines").collect()] == ['{"a":1}']


def test_one_hot_high_cardinality_vector(spark):
    df = spark.range(300).select(F.col("id"), F.format_string("c%03d", F.col("id") % 260).alias("cat"),
                                 F.lit("x").alias("small"))
    with pytest.raises(ValueError):
        encode.one_hot(df, ["cat"])
    out, model = encode.one_hot_vector(df, "cat")
    row = out.where("id = 5").collect()[0]
    assert row.cat_vec.size == 261 and row.cat_vec[5] == 1.0  # 260 values + one slot for unseen
    # a batch with few of the values, scored with the fitted encoder: the same width
    few, _ = encode.one_hot_vector(df.where("id in (5, 7)"), "cat", model=model)
    assert {r.cat_vec.size for r in few.collect()} == {261}
