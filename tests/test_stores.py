"""Published tables, stored prediction files, streams with faults, and the day-partitioned generation table."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from pricelab.session import path_exists, scratch_path
from pricelab.sinks import writers
from pricelab.sources import feeds, predictions, prices
from pricelab.streaming import streams

START = dt.datetime(2024, 3, 1)


def _local(path):
    return path.removeprefix("file:")


# --- publishing ---------------------------------------------------------------------------------------

def test_readers_see_whole_versions(spark):
    base = scratch_path(spark, "publish-test")
    with pytest.raises(FileNotFoundError):
        writers.current_version(spark, base)
    df = spark.range(100).selectExpr("id", "id % 3 AS year", "id % 2 AS month")
    first = writers.publish(df, base)
    held = writers.read_published(spark, base)
    writers.publish(df.where("id < 10"), base)
    assert held.count() == 100 and writers.read_published(spark, base).count() == 10
    third = writers.publish(df.where("id < 5"), base)
    assert writers.current_version(spark, base) == third
    assert not path_exists(spark, first) and path_exists(spark, third)            # two versions stay
    assert "year" in writers.read_published(spark, base).columns


def test_a_failed_write_changes_nothing(spark):
    base = scratch_path(spark, "publish-fail")
    writers.publish(spark.range(7), base)
    with pytest.raises(Exception, match="broken"):
        writers.publish(spark.range(9).select(F.raise_error(F.lit("broken")).alias("id")), base)
    assert writers.read_published(spark, base).count() == 7


def test_files_grow_with_the_rows(spark):
    """All rows of one month: files hold ``file_rows`` rows at most, none is lost, and small months have one file."""
    df = spark.range(0, 1000, numPartitions=16).selectExpr("id", "2024 AS year", "CASE WHEN id < 990 THEN 1 ELSE 2 END AS month")
    out = scratch_path(spark, "files-test")
    writers.write_clean(df, out, file_rows=100)
    files = {m: [f for f in os.listdir(f"{_local(out)}/year=2024/month={m}") if f.endswith(".parquet")] for m in (1, 2)}
    assert len(files[1]) >= 10 and len(files[2]) == 1
    assert spark.read.parquet(out).count() == 1000
    assert max(r.n for r in spark.read.parquet(out).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) <= 100


def test_latest_run_skips_unfinished_ones(spark):
    base = scratch_path(spark, "runs-test")
    for stamp in ("20250101_000000", "20250101_000001", "20250101_000002"):
        writers.write_run(spark.range(3), base, stamp)
    os.remove(f"{_local(base)}/run=20250101_000002/_SUCCESS")
    assert prices.latest_run(spark, base, "*.parquet").endswith("run=20250101_000001")


# --- stored predictions -------------------------------------------------------------------------------

def test_header_names_target_and_models():
    cols = ["timestamp", "actual_price", "tree_predicted_price", "tree_error", "seq_predicted_price", "odd_predicted_load"]
    assert predictions.target_of(cols) == "price" and predictions.models_of(cols, "price") == ["tree", "seq"]
    with pytest.raises(ValueError, match="actual_"):
        predictions.target_of(["timestamp", "price"])


def test_wide_files_become_long(spark):
    rows = [("t1", "10", "9.5", "0.75", "8"), ("t2", "20", None, None, "21"), ("t3", None, "5", "", "NaN"), ("t4", "x", "1", "2", "3")]
    wide = spark.createDataFrame(rows, "timestamp string, actual_p string, a_predicted_p string, a_error string, b_predicted_p string")
    got = {(r.timestamp, r.model): (r.actual, r.predicted, r.error) for r in predictions.to_long(wide).collect()}
    assert got == {("t1", "a"): (10, 9.5, 0.75), ("t1", "b"): (10, 8, 2), ("t2", "b"): (20, 21, -1), ("t3", "a"): (None, 5, None),
                   ("t4", "a"): (None, 1, 2), ("t4", "b"): (None, 3, None)}
    assert predictions.to_long(wide.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no model"):
        predictions.to_long(wide.select("timestamp", "actual_p"))


def test_newest_file_of_a_folder_is_read(spark):
    folder = scratch_path(spark, "files")
    os.makedirs(_local(folder))
    for i, name in enumerate(["old.csv", "new.csv"]):
        with open(f"{_local(folder)}/{name}", "w") as f:
            f.write(f"timestamp,actual_p,a_predicted_p\nt{i},{i + 1},{i}\n")
        os.utime(f"{_local(folder)}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    assert [(r.timestamp, r.actual, r.error) for r in predictions.read_latest(spark, folder).collect()] == [("t1", 2.0, 1.0)]


# --- streams ------------------------------------------------------------------------------------------

def _weather(i):
    return json.dumps({"main": {"temp": float(i), "humidity": 50.0}, "wind": {"speed": 1.0}, "clouds": {"all": 10.0}})


def _land(spark, path, docs):
    rows = [(i, START + dt.timedelta(minutes=i), text) for i, text in docs]
    streams.land_json(spark.createDataFrame(rows, "doc_id long, observed_at timestamp_ntz, json string"), path, mode="append")


def test_a_failing_cycle_is_logged_and_the_loop_goes_on(spark):
    """Three landings: the second one's batch never succeeds and is kept whole; malformed documents are kept apart."""
    root = scratch_path(spark, "faults")

    def check(batch, epoch):
        if batch.where("doc_id = 11").count():
            raise RuntimeError("service down")

    for first in (0, 10, 20):
        docs = [(first + k, _weather(k)) for k in range(5)]
        docs += [(first + 5, "{\"main\": "), (first + 6, "[1, 2]"), (first + 7, None), (first + 8, "{\"main\": {}}")]
        _land(spark, f"{root}/in", docs)
        starts = streams.supervise(lambda: streams.weather_records_stream(
            spark, f"{root}/in", f"{root}/solar", f"{root}/out", f"{root}/rejected", f"{root}/ck", dead_path=f"{root}/dead", attempts=3, before_batch=check))
        assert starts == 1

    def ids(path):
        return sorted(r.doc_id for r in spark.read.parquet(path).collect())

    assert ids(f"{root}/out") == [0, 1, 2, 3, 4, 20, 21, 22, 23, 24]
    assert ids(f"{root}/rejected") == [8, 28]
    assert ids(f"{root}/dead/documents") == [5, 6, 7, 25, 26, 27]
    assert ids(f"{root}/dead/batches") == list(range(10, 19))
    failures = spark.read.parquet(f"{root}/dead/failures").collect()
    assert sorted(r.attempt for r in failures) == [1, 2, 3] and all("service down" in r.message and r.failed_at for r in failures)


def test_supervise_starts_again_from_the_checkpoint(spark):
    """Without a dead-letter folder a fault ends the query; it is started again and loses nothing."""
    root, left = scratch_path(spark, "restart"), [2]

    def check(batch, epoch):
        if left[0]:
            left[0] -= 1
            raise RuntimeError("not yet")

    _land(spark, f"{root}/in", [(k, _weather(k)) for k in range(4)])
    said = []
    starts = streams.supervise(lambda: streams.weather_records_stream(
        spark, f"{root}/in", f"{root}/solar", f"{root}/out", f"{root}/rejected", f"{root}/ck", before_batch=check), pause=0.0, log=said.append)
    assert starts == 3 and len(said) == 2 and spark.read.parquet(f"{root}/out").count() == 4
    left[0] = 99
    _land(spark, f"{root}/in", [(9, _weather(9))])
    with pytest.raises(Exception, match="not yet"):
        streams.supervise(lambda: streams.weather_records_stream(
            spark, f"{root}/in", f"{root}/solar", f"{root}/out", f"{root}/rejected", f"{root}/ck", before_batch=check), restarts=1, pause=0.0, log=said.append)


def _generation(day, period, quantity):
    return json.dumps({"settlement_date": day, "settlement_period": period,
                       "data": [{"businessType": "Solar generation", "quantity": quantity}, {"businessType": "Wind generation", "quantity": 9.0}]})


def _land_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def test_solar_table_is_compacted_and_goes_on_anew(spark, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT_EPOCHS", 2)
    monkeypatch.setattr(streams.drop_compacted, "__defaults__", (2,))
    root = scratch_path(spark, "compact")
    for i in range(8):
        _land_lines(spark, f"{root}/in", [_generation(f"2024-03-0{1 + i % 3}", 20, 1.5)])
        streams.solar_totals_stream(spark, f"{root}/in", f"{root}/table", f"{root}/ck").awaitTermination()
    want = {1: 4, 2: 4, 3: 3}                     # 3, 3 and 2 entries of 1.5, truncated
    got = {r.settlement_date.day: r.solar_generation for r in streams.read_solar_table(spark, f"{root}/table").collect()}
    assert got == want
    assert len([p for p in os.listdir(_local(f"{root}/table")) if p.startswith("epoch=")]) <= 5
    # a stream with a new checkpoint numbers its epochs from 0; what it writes is newer all the same
    _land_lines(spark, f"{root}/in", [_generation("2024-03-03", 20, 10.0)])
    streams.solar_totals_stream(spark, f"{root}/in", f"{root}/table", f"{root}/ck2").awaitTermination()
    got = {r.settlement_date.day: r.solar_generation for r in streams.read_solar_table(spark, f"{root}/table").collect()}
    assert got == {**want, 3: 13}


def test_one_day_reads_one_folder(spark):
    root = scratch_path(spark, "days")
    lines = [_generation(f"2024-03-0{d}", p, d + 0.25) for d in (1, 2, 3) for p in (1, 20, 48)] + ["{", _generation("no day", 20, 5.0)]
    _land_lines(spark, f"{root}/in", lines)
    streams.generation_table_stream(spark, f"{root}/in", f"{root}/table", f"{root}/ck").awaitTermination()
    table = spark.read.parquet(f"{root}/table")
    docs = spark.createDataFrame([(x,) for x in lines], "json string")
    want = {r.settlement_date: r.solar_generation for r in feeds.solar_total(docs).collect()}
    assert {r.settlement_date: r.solar_generation for r in streams.solar_total_of_table(table).collect()} == want and len(want) == 3
    one = streams.solar_total_of_table(table, settlement_date=dt.date(2024, 3, 2))
    assert [tuple(r) for r in one.collect()] == [(dt.date(2024, 3, 2), want[dt.date(2024, 3, 2)])]
    scan = [x for x in one._jdf.queryExecution().toString().split("\n") if "FileScan" in x][-1]
    assert "PartitionFilters: [isnotnull(settlement_date" in scan and "2024-03-02" in scan.split("PushedFilters")[0]
    assert [tuple(r) for r in streams.solar_total_of_table(table, settlement_date=dt.date(2030, 1, 1)).collect()] == [(dt.date(2030, 1, 1), 0)]
    some = streams.solar_total_of_table(table, days=spark.createDataFrame([(dt.date(2024, 3, 1),)] * 2, "settlement_date date"))
    assert [r.settlement_date.day for r in some.collect()] == [1]


def test_late_rows_and_duplicates_in_windows(spark):
    """A row behind the watermark is left out, one inside it counts; a duplicate counts once."""
    root = scratch_path(spark, "late")
    schema = "k long, at timestamp, v double"
    parts = [[(1, 0, 1.0), (2, 5, 3.0), (2, 5, 3.0), (3, 200, 5.0)], [(4, 150, 7.0), (5, 10, 100.0), (6, 400, 0.0)], [(7, 900, 0.0)]]
    for part in parts:
        rows = [(k, START + dt.timedelta(minutes=m), v) for k, m, v in part]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        out = streams.tumbling_average_stream(stream, "at", "v", ["k"])
        streams.start_to_parquet(out, f"{root}/out", f"{root}/ck").awaitTermination()
    got = {int((r.window_start - START).total_seconds() // 60): (r.n, r.avg_value) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got[0] == (2, 2.0) and got[150] == (1, 7.0) and got[195] == (1, 5.0)
