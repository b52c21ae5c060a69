"""Derivations of the given test tables used by the registered keys.

The reference's inputs (price CSVs, weather / generation / carbon / load
documents, model predictions) are not shipped, so each key builds them from
the driver's tables with Spark -- the work grows with the tables. The same
rules are written out in SQL in :mod:`pricelab.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which rows get a missing value (by key arithmetic).
VALUE_GAP_MOD = 17
EVENT_TYPE_GAP_MOD = 13
USER_GAP_MOD = 31
SPOILED_TIME_MOD = 19
OTHER_FORMAT_MOD = 3
NAN_MOD = 23
OUTLIER_MOD = 41
# Document shapes built from events.
NO_RAIN_MOD = 3            # rain block absent
NO_TEMPERATURE_MOD = 29    # main.temp absent -> rejected reading
NO_GENERATION_MOD = 7      # generation document without data
EMPTY_CARBON_MOD = 5       # carbon document with an empty list
SHORT_START_MOD = 9        # load document missing its last start
EMPTY_LOAD_MOD = 10        # load document without records
# Stand-in predictors for l_extendedprice.
TREE_FACTOR = 1500.0
SEQUENCE_FACTOR = 1400.0
LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SEQUENCE_LENGTH = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _gap(c: str, key: Column, mod: int) -> Column:
    return F.when(key % mod == 0, F.lit(None)).otherwise(F.col(c)).alias(c)


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return ev.select("event_id", "ts",
                     _gap("user_id", k, USER_GAP_MOD),
                     _gap("event_type", k, EVENT_TYPE_GAP_MOD),
                     _gap("value", k, VALUE_GAP_MOD),
                     "props")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with gaps, NaN, outliers, and times as text: ISO, day/month/year or no time at all."""
    ev, k = events_with_gaps(spark, sf_dir), F.col("event_id")
    observed = F.when(k % SPOILED_TIME_MOD == 0, F.lit("not a date")) \
        .when(k % OTHER_FORMAT_MOD == 0, F.date_format("ts", "dd/MM/yyyy HH:mm")).otherwise(F.col("ts").cast("string"))
    value = F.when(k % NAN_MOD == 0, F.lit(float("nan"))).when(k % OUTLIER_MOD == 0, F.col("value") * 100).otherwise(F.col("value"))
    return ev.select("event_id", observed.alias("Seen At"), "user_id", "event_type", value.alias("Value"))


# ---------------------------------------------------------------- feed documents

def weather_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, observed_at, json) -- one weather document per event."""
    ev = table(spark, sf_dir, "events")
    k, v = F.col("event_id"), F.col("value")
    main = F.struct(F.when(k % NO_TEMPERATURE_MOD != 0, v / 4 - 5).alias("temp"),
                    (F.col("user_id") % 100).cast("double").alias("humidity"))
    rain = F.when(k % NO_RAIN_MOD != 0, F.struct((v / 100).alias("1h")))
    doc = F.struct(main.alias("main"),
                   F.struct((v / 10).alias("speed")).alias("wind"),
                   F.struct(((k * 7) % 101).cast("double").alias("all")).alias("clouds"),
                   rain.alias("rain"))
    return ev.select(k.alias("doc_id"), F.col("ts").alias("observed_at"), F.to_json(doc).alias("json"))


def settlement_period(ts: Column) -> Column:
    """Half-hour period of the day, 1..48."""
    return F.hour(ts) * 2 + F.floor(F.minute(ts) / 30).cast("int") + 1


def generation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k, v = F.col("event_id"), F.col("value")
    data = F.when(k % NO_GENERATION_MOD != 0, F.array(
        F.struct(F.lit("Solar generation").alias("businessType"), v.alias("quantity")),
        F.struct(F.lit("Wind generation").alias("businessType"), (v * 3).alias("quantity"))))
    doc = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("settlement_date"),
                   settlement_period(F.col("ts")).alias("settlement_period"),
                   data.alias("data"))
    return ev.select(k.alias("doc_id"), F.to_json(doc).alias("json"))


def carbon_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k, v = F.col("event_id"), F.col("value")
    index = F.when(v < 30, "low").when(v < 70, "moderate").otherwise("high")
    first = F.struct(F.struct(F.col("user_id").alias("actual"),
                              (F.col("user_id") + k % 10).alias("forecast"),
                              index.alias("index")).alias("intensity"))
    later = F.struct(F.struct(F.lit(0).alias("actual"), F.lit(0).alias("forecast"),
                              F.lit("later").alias("index")).alias("intensity"))
    data = F.when(k % EMPTY_CARBON_MOD == 0, F.array().cast("array<struct<intensity:struct<actual:bigint,forecast:bigint,index:string>>>")) \
        .otherwise(F.array(first, later))
    return ev.select(k.alias("doc_id"), F.to_json(F.struct(data.alias("data"))).alias("json"))


def load_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): 1..4 quarter-hour records per event; some documents miss
    their last start, some have no records."""
    ev = table(spark, sf_dir, "events")
    k, v = F.col("event_id"), F.col("value")
    n = (k % 4 + 1).cast("int")
    idx = F.sequence(F.lit(0), n - 1)
    base = F.date_trunc("second", F.col("ts"))
    starts = F.transform(idx, lambda i: F.date_format(
        base + F.make_dt_interval(F.lit(0), F.lit(0), i * 15), "yyyy-MM-dd HH:mm:ss"))
    starts = F.when(k % SHORT_START_MOD == 0, F.slice(starts, 1, n - 1)).otherwise(starts)
    qty = F.transform(idx, lambda i: (v + i).cast("string"))
    start_xml = F.array_join(F.transform(starts, lambda s: F.concat(F.lit("<start>"), s, F.lit("</start>"))), "")
    qty_xml = F.array_join(F.transform(qty, lambda q: F.concat(F.lit("<quantity>"), q, F.lit("</quantity>"))), "")
    body = F.when(k % EMPTY_LOAD_MOD == 0, F.lit("")).otherwise(F.concat(start_xml, qty_xml))
    xml = F.concat(F.lit("<Publication><TimeSeries><Period>"), body,
                   F.lit("</Period></TimeSeries></Publication>"))
    return ev.select(k.alias("doc_id"), xml.alias("xml"))


def price_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price-tick records {timestamp, price, volatility} from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("ts").cast("timestamp").alias("timestamp"),
                     F.col("value").alias("price"),
                     (F.col("value") / 100).alias("volatility"))


# ---------------------------------------------------------------- predictions

def lineitem_predictions(spark: SparkSession, sf_dir: str, positions: bool = False) -> DataFrame:
    """Actuals with two stand-in model predictions, key, time and the
    chronological split (sequence predictions only where 24 earlier rows of
    the same split exist, as a sequence model would give).

    Long form: key..., ts, split, model, actual, predicted; with ``positions`` (a
    full sort) also split_pos.
    """
    from pricelab.operators.series import chronological_split, split_labels

    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_KEY, "l_shipdate", "l_quantity", "l_extendedprice")
    order = ["l_shipdate", *LINEITEM_KEY]
    if positions:
        s = chronological_split(li, order, keep_position=False).withColumn("preceded", F.col("split_pos") >= SEQUENCE_LENGTH)
    else:
        s = split_labels(li, order, preceded_by=SEQUENCE_LENGTH)
    common = [*LINEITEM_KEY, F.col("l_shipdate").alias("ts"), "split", *(["split_pos"] if positions else []),
              F.col("l_extendedprice").alias("actual")]
    tree = s.select(*common, F.lit("tree").alias("model"),
                    (F.col("l_quantity") * TREE_FACTOR).alias("predicted"))
    seq = s.where("preceded").select(
        *common, F.lit("sequence").alias("model"), (F.col("l_quantity") * SEQUENCE_FACTOR).alias("predicted"))
    return tree.unionByName(seq)


def lineitem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predictions with a column per model (rows that share a key stay apart): key..., ts, actual,
    tree_predicted, sequence_predicted (NULL where the sequence has none), and the errors."""
    from pricelab.operators.series import split_labels

    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_KEY, "l_shipdate", "l_quantity", "l_extendedprice")
    s = split_labels(li, ["l_shipdate", *LINEITEM_KEY], preceded_by=SEQUENCE_LENGTH)
    x = s.select(*LINEITEM_KEY, F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("actual"),
                 (F.col("l_quantity") * TREE_FACTOR).alias("tree_predicted"),
                 F.when(F.col("preceded"), F.col("l_quantity") * SEQUENCE_FACTOR).alias("sequence_predicted"))
    return x.withColumns({f"{m}_error": F.col("actual") - F.col(f"{m}_predicted") for m in ("tree", "sequence")})
