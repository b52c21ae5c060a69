"""Structured Streaming forms of the ingest loop.

The reference polls two web services every 15 minutes and builds one weather
record per cycle. Here the feeds are landed files read with ``readStream``:

* generation documents feed a stateful per-day aggregation (update mode)
  whose changed days go to an epoch folder of a small solar-totals table
  (idempotent, so a replayed batch rewrites the same folder; compacted);
* weather documents are parsed per micro-batch and joined with that table,
  read fresh inside ``foreachBatch`` (a growing day's total is always
  current, and the join side stays one row per day instead of re-aggregating
  the whole generation feed); each batch writes its own ``epoch=`` folder with
  overwrite, so a replay after a failure does not duplicate rows.

A simpler stream-static variant (``weather_stream``) joins any batch frame.
Every query keeps a checkpoint, so a lost executor or a restarted driver
resumes from the last committed batch. Tests use ``trigger(availableNow=True)``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelab.session import path_exists, remove_path, small_frame
from pricelab.sources import feeds

WINDOW = "15 minutes"
WATERMARK = "1 hour"
#: Epoch folders of the solar table between two that hold every day.
COMPACT_EPOCHS = 32
#: Characters of an error message that are kept.
MESSAGE = 2000
# Landed JSON keeps full microsecond times (the JSON default is milliseconds).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def land_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write records as JSON lines the stream readers below can replay."""
    df.write.mode(mode).option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).json(path)


def tumbling_average(df: DataFrame, time_col: str, value_col: str, window: str = WINDOW) -> DataFrame:
    """Batch form of R3: count and mean per tumbling window (window_start,
    window_end, n, avg_value)."""
    w = F.window(F.col(time_col), window)
    return (df.groupBy(w.alias("w"))
              .agg(F.count(value_col).alias("n"), F.avg(value_col).alias("avg_value"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "n", "avg_value"))


def tumbling_average_stream(stream: DataFrame, time_col: str, value_col: str, key_cols: list[str],
                            window: str = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    """Event-time form of R3 for append mode: watermark, duplicate drop within
    the watermark, 15-minute tumbling windows. ``time_col`` must be a
    ``timestamp`` (watermarks reject ``timestamp_ntz``: cast with the session
    zone set to UTC)."""
    s = stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(key_cols)
    w = F.window(F.col(time_col), window)
    return (s.groupBy(w.alias("w"))
             .agg(F.count(value_col).alias("n"), F.avg(value_col).alias("avg_value"))
             .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "n", "avg_value"))


def read_json_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of landed JSON documents, one per line, kept as text."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).withColumnRenamed("value", "json")


def weather_stream(spark: SparkSession, weather_path: str, solar_by_day: DataFrame,
                   observed_col: str = "observed_at") -> tuple[DataFrame, DataFrame]:
    """(records, rejected) streams for R1.

    Landed weather files hold ``{"doc_id":..,"observed_at":..,"json":..}``
    lines; readings without a temperature go to the rejected stream (F4).
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()),
                           T.StructField(observed_col, T.TimestampNTZType()),
                           T.StructField("json", T.StringType())])
    raw = spark.readStream.schema(schema).option("timestampNTZFormat", TS_FORMAT).json(weather_path)
    flat = feeds.weather_flatten(raw, keep=["doc_id", observed_col])
    ok, bad = feeds.weather_guard(flat)
    records = feeds.weather_record(ok, solar_by_day, time_col=observed_col)
    return records, bad


def solar_totals_stream(spark: SparkSession, generation_path: str, table_path: str, checkpoint: str,
                        available_now: bool = True, interval: str = WINDOW,
                        period_from: int = feeds.SETTLEMENT_PERIOD_FROM,
                        period_to: int = feeds.SETTLEMENT_PERIOD_TO):
    """Maintain per-day solar totals (A8 over a stream) in ``table_path``.

    Every micro-batch writes the days whose total changed to a folder of its
    own (``epoch={id}``: a replay overwrites the same folder), and readers take
    the newest epoch of each day (:func:`read_solar_table`), so nothing is
    replaced under a reader. Landed files hold one generation document (JSON)
    per line; documents without a valid date add to no day."""
    raw = read_json_lines(spark, generation_path)
    e = feeds.generation_entries(raw, "json").where(F.col("settlement_period").between(period_from, period_to))
    running = e.where("settlement_date is not null").groupBy("settlement_date").agg(feeds.solar_micro_sum().alias("solar_micro"))

    def write(batch: DataFrame, epoch: int) -> None:
        out = batch.select("settlement_date", feeds.solar_from_micro("solar_micro").alias("solar_generation"),
                           F.current_timestamp().alias("written_at"))
        if epoch % COMPACT_EPOCHS == COMPACT_EPOCHS - 1:
            before = read_solar_table(batch.sparkSession, table_path).withColumn("written_at", F.current_timestamp())
            out = out.unionByName(before.join(out.select("settlement_date"), "settlement_date", "left_anti")).checkpoint(eager=True)
        out.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")
        drop_compacted(batch.sparkSession, table_path, epoch)

    w = running.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def drop_compacted(spark: SparkSession, table_path: str, epoch: int, every: int = COMPACT_EPOCHS) -> None:
    """After the epoch that begins a new round, remove the folders that the whole folder before the last one replaces
    (so a reader that listed them has a round's time to end)."""
    if epoch % every == 0:
        for e in range(max(0, epoch - 2 * every - 1), epoch - every - 1):
            remove_path(spark, f"{table_path}/epoch={e}")


def read_solar_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The per-day totals written last as (settlement_date, solar_generation); empty when nothing has been written
    yet. The newest by time counts, so a stream that starts anew (and numbers its epochs anew) goes on."""
    if not path_exists(spark, table_path):
        return small_frame(spark, [], "settlement_date date, solar_generation long")
    rows = spark.read.schema("settlement_date date, solar_generation long, written_at timestamp, epoch long").parquet(table_path)
    return rows.groupBy("settlement_date").agg(F.max_by("solar_generation", F.struct("written_at", "epoch")).alias("solar_generation"))


def generation_table_stream(spark: SparkSession, generation_path: str, table_path: str, checkpoint: str,
                            available_now: bool = True, interval: str = WINDOW):
    """generation documents parsed once into a table that is partitioned by settlement day (entries: settlement_period,
    businessType, quantity). A question for one day then reads that day's folder only (:func:`solar_total_of_table`).

    The file sink commits whole micro-batches; documents without a valid date have no day and are left out (see
    ``feeds.malformed_generation``)."""
    entries = feeds.generation_entries(read_json_lines(spark, generation_path), "json").where("settlement_date is not null")
    w = (entries.repartition("settlement_date").writeStream.format("parquet").partitionBy("settlement_date")
         .option("path", table_path).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def solar_total_of_table(table: DataFrame, settlement_date=None, days: DataFrame | None = None,
                         period_from: int = feeds.SETTLEMENT_PERIOD_FROM, period_to: int = feeds.SETTLEMENT_PERIOD_TO) -> DataFrame:
    """A8 from the day-partitioned table: (settlement_date, solar_generation) of one day, of the ``days`` of another
    frame (column settlement_date, J2; partitions are pruned while it runs), or of all. One day always has a row."""
    x = table.where(F.col("settlement_period").between(period_from, period_to))
    if days is not None:
        x = x.join(days.select("settlement_date").distinct(), "settlement_date", "left_semi")
    if settlement_date is not None:
        x = x.where(F.col("settlement_date") == F.to_date(F.lit(str(settlement_date))))
    sums = x.groupBy("settlement_date").agg(feeds.solar_micro_sum().alias("solar_micro"))
    if settlement_date is not None:
        asked = table.sparkSession.range(1).select(F.to_date(F.lit(str(settlement_date))).alias("settlement_date"))
        sums = asked.join(sums, "settlement_date", "left")
    micro = F.coalesce(F.col("solar_micro"), F.lit(0).cast("long"))
    return sums.withColumn("solar_micro", micro).select("settlement_date", feeds.solar_from_micro("solar_micro").alias("solar_generation"))


def guarded(write: Callable[[DataFrame, int], None], dead_path: str, attempts: int = 2, pause: float = 0.0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function under which a failing cycle is logged and the loop goes on.

    A batch whose ``write`` raises is tried again, up to ``attempts`` times with growing pauses. Each failure leaves a row
    (epoch, attempt, message, failed_at) under ``{dead_path}/failures``; a batch that never succeeds is kept whole, as it came,
    under ``{dead_path}/batches/epoch={id}``, to be landed again when the fault is mended. If even that can't be
    written, the query fails and :func:`supervise` starts it again from its checkpoint."""
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        for attempt in range(1, attempts + 1):
            try:
                write(batch, epoch)
                return
            except Exception as e:  # noqa: BLE001 - any fault of a cycle is logged
                row = small_frame(spark, [(int(epoch), attempt, f"{type(e).__name__}: {str(e)[:MESSAGE]}")], "epoch long, attempt int, message string")
                row.withColumn("failed_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{dead_path}/failures/at={epoch}-{attempt}")
                time.sleep(pause * attempt)
        batch.write.mode("overwrite").parquet(f"{dead_path}/batches/epoch={epoch}")

    return run


def supervise(start: Callable[[], object], restarts: int = 5, pause: float = 1.0, log: Callable[[str], None] = print) -> int:
    """Run a streaming query to its end, starting it again from its checkpoint when it fails (with growing pauses).

    ``start`` starts the query and returns it. A query that gets further than its last start did has its count of
    restarts set back, so only ``restarts`` failures without progress end the loop (the last fault is raised). Returns how
    often the query was started."""
    tried, starts, reached = 0, 0, -1
    while True:
        starts += 1
        query = start()
        try:
            query.awaitTermination()
            return starts
        except Exception as e:  # noqa: BLE001 - the loop goes on
            last = query.lastProgress
            at = -1 if last is None else int(last["batchId"])
            tried = 1 if at > reached else tried + 1
            reached = max(reached, at)
            log(f"streaming query failed after batch {at}: {str(e)[:MESSAGE]}")
            if tried > restarts:
                raise
            time.sleep(pause * tried)


def weather_records_stream(spark: SparkSession, weather_path: str, solar_table: str, out_path: str,
                           rejected_path: str, checkpoint: str, available_now: bool = True,
                           interval: str = WINDOW, observed_col: str = "observed_at", dead_path: str | None = None,
                           attempts: int = 2, before_batch: Callable[[DataFrame, int], None] | None = None):
    """R1 with a maintained solar table: per micro-batch, flatten and guard
    the readings, join the freshly read per-day totals, write records and
    rejects to ``{path}/epoch={id}`` (overwrite: replay-safe).

    With ``dead_path``, documents that are no JSON object go there as they came (``documents/epoch={id}``: doc_id,
    time, json), and a failing batch doesn't end the stream (:func:`guarded`). ``before_batch`` is called with every
    batch first (a health check of a service, say); what it raises fails the batch."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()),
                           T.StructField(observed_col, T.TimestampNTZType()),
                           T.StructField("json", T.StringType())])
    raw = spark.readStream.schema(schema).option("timestampNTZFormat", TS_FORMAT).json(weather_path)
    whole = F.coalesce(F.col("json").rlike(r"^\s*\{") & F.get_json_object("json", "$").isNotNull(), F.lit(False))

    def write(batch: DataFrame, epoch: int) -> None:
        if before_batch is not None:
            before_batch(batch, epoch)
        if dead_path is not None:
            batch.where(~whole).write.mode("overwrite").parquet(f"{dead_path}/documents/epoch={epoch}")
            batch = batch.where(whole)
        flat = feeds.weather_flatten(batch, keep=["doc_id", observed_col]).persist()  # parsed once for both sinks
        try:
            ok, bad = feeds.weather_guard(flat)
            rec = feeds.weather_record(ok, read_solar_table(spark, solar_table), time_col=observed_col)
            rec.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/epoch={epoch}")
        finally:
            flat.unpersist()

    w = raw.writeStream.foreachBatch(write if dead_path is None else guarded(write, dead_path, attempts))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def start_to_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                     interval: str = WINDOW, mode: str = "append"):
    """Start a checkpointed parquet sink; ``available_now`` drains what has
    landed and stops, otherwise a ``processingTime`` trigger every
    ``interval`` (the reference's 15-minute cadence)."""
    w = stream.writeStream.format("parquet").outputMode(mode) \
        .option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def price_tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Price ticks {timestamp, price, volatility} as they land."""
    return spark.readStream.schema(feeds.PRICE_TICK_SCHEMA).option("timestampFormat", TS_FORMAT).json(path)
