"""Weather, generation, carbon-intensity and load feeds (S4-S7, S8, P16, J2,
F4, T3, A8).

The reference fetches one document per call; here each feed is a column of
documents (JSON or XML text) -- landed files read with ``spark.read.text`` /
``readStream`` or a column of a table -- parsed with ``from_json`` / ``from_xml``
on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelab.functions.solar import solar_estimate_kw

# Business type that counts as solar output; settlement periods
# requested from the generation feed.
SOLAR_BUSINESS_TYPE = "Solar generation"
SETTLEMENT_PERIOD_FROM = 3
SETTLEMENT_PERIOD_TO = 47
MICRO = 1_000_000

WEATHER_SCHEMA = T.StructType([
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()),
        T.StructField("humidity", T.DoubleType())])),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType())])),
    T.StructField("clouds", T.StructType([T.StructField("all", T.DoubleType())])),
    T.StructField("rain", T.StructType([T.StructField("1h", T.DoubleType())])),
])

GENERATION_SCHEMA = T.StructType([
    T.StructField("settlement_date", T.StringType()),
    T.StructField("settlement_period", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("businessType", T.StringType()),
        T.StructField("quantity", T.DoubleType())]))),
])

CARBON_SCHEMA = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("intensity", T.StructType([
            T.StructField("actual", T.DoubleType()),
            T.StructField("forecast", T.DoubleType()),
            T.StructField("index", T.StringType())]))]))),
])

PRICE_TICK_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("volatility", T.DoubleType()),
])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- S4, P15

def weather_flatten(docs: DataFrame, json_col: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Flatten weather documents: temperature, wind_speed, cloud_cover,
    humidity, precipitation (``rain.1h``, absent -> 0) and the cloud-based
    solar estimate in kW."""
    w = F.from_json(_c(json_col), WEATHER_SCHEMA)
    # the parsed document leaves through a one-row generator: a later filter
    # on its fields (the F4 guard) then stays above it instead of being pushed
    # under the parse and tokenising every document a second time
    parsed = docs.select(*(keep or []), F.explode_outer(F.array(w)).alias("__w"))
    cloud = F.col("__w.clouds.all")
    return parsed.select(
        *(keep or []),
        F.col("__w.main.temp").alias("temperature"),
        F.col("__w.wind.speed").alias("wind_speed"),
        cloud.alias("cloud_cover"),
        F.col("__w.main.humidity").alias("humidity"),
        F.coalesce(F.col("__w.rain").getField("1h"), F.lit(0.0)).alias("precipitation"),
        solar_estimate_kw(cloud).alias("solar_estimate_kw"),
    )


def weather_guard(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a reading without temperature is rejected.
    Two frames for two sinks (e.g. records and a reject table)."""
    ok = F.col("temperature").isNotNull()
    return flat.where(ok), flat.where(~ok)


def weather_status(flat: DataFrame, col: str = "status") -> DataFrame:
    """F4 in one pass: every reading tagged ``accepted`` / ``rejected``."""
    return flat.withColumn(col, F.when(F.col("temperature").isNotNull(), F.lit("accepted"))
                           .otherwise(F.lit("rejected")))


# ---------------------------------------------------------------- S5, F2, F3, A8

def generation_entries(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per ``data`` entry: settlement_date, settlement_period,
    businessType, quantity. A document without entries keeps one row with
    NULL business type and quantity.

    The day and period travel inside each generated entry, so a later filter
    on them stays above the generator instead of being pushed under the
    parse (which would parse every document a second time).
    """
    entry_t = GENERATION_SCHEMA["data"].dataType.elementType
    g = docs.select(F.from_json(_c(json_col), GENERATION_SCHEMA).alias("__g"))
    data = F.col("__g.data")
    blank = F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in entry_t.fields]))
    filled = F.when(F.size(F.coalesce(data, F.array())) > 0, data).otherwise(blank)
    # a malformed date keeps its document, with a NULL day (see malformed_generation)
    day = F.col("__g.settlement_date").cast("string").try_cast("date")
    period = F.col("__g.settlement_period")
    entries = F.transform(filled, lambda e: F.struct(
        day.alias("settlement_date"), period.alias("settlement_period"),
        e.getField("businessType").alias("businessType"), e.getField("quantity").alias("quantity")))
    return g.select(F.inline(entries))


def solar_total(docs: DataFrame, json_col: str = "json", settlement_date=None,
                period_from: int = SETTLEMENT_PERIOD_FROM,
                period_to: int = SETTLEMENT_PERIOD_TO) -> DataFrame:
    """Per settlement day: sum of solar quantities over periods
    ``period_from..period_to``, truncated to an integer; 0 when a day has no
    solar entry (A8).

    ``settlement_date`` restricts to one day (the reference asks for today);
    None keeps every day. The sum is exact: quantities are added as whole
    micro-units in a long (exact for up to 6 decimals; a fast fixed-width
    aggregate, unlike a wide decimal), then truncated toward zero.
    """
    e = generation_entries(docs, json_col)
    cond = F.col("settlement_period").between(period_from, period_to)
    if settlement_date is not None:
        cond = cond & (F.col("settlement_date") == F.to_date(F.lit(str(settlement_date))))
    sums = (e.where(cond & F.col("settlement_date").isNotNull())
            .groupBy("settlement_date").agg(solar_micro_sum().alias("solar_micro")))
    if settlement_date is not None:
        # the asked day has a row even without entries: its total is 0
        asked = e.sparkSession.range(1).select(F.to_date(F.lit(str(settlement_date))).alias("settlement_date"))
        sums = (asked.join(sums, "settlement_date", "left")
                .select("settlement_date", F.coalesce("solar_micro", F.lit(0).cast("long")).alias("solar_micro")))
    return sums.select("settlement_date", solar_from_micro("solar_micro").alias("solar_generation"))


def malformed_generation(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """The documents that give no settlement date: not JSON, no date, or one that doesn't parse."""
    date = F.from_json(_c(json_col), GENERATION_SCHEMA).getField("settlement_date").cast("string")
    return docs.where(date.try_cast("date").isNull())


def solar_micro_sum() -> Column:
    """Aggregate: exact sum of solar quantities in micro-units (0 if none)."""
    micro = F.round(F.col("quantity") * F.lit(MICRO)).cast("long")
    solar_q = F.when(F.col("businessType") == F.lit(SOLAR_BUSINESS_TYPE), micro)
    return F.coalesce(F.sum(solar_q), F.lit(0).cast("long"))


def solar_from_micro(micro_col: str) -> Column:
    """Micro-unit total to the integer total; SQL ``div`` truncates toward
    zero, like int() on the float total."""
    return F.expr(f"`{micro_col}` div {MICRO}")


# ---------------------------------------------------------------- S6

def carbon_intensity(docs: DataFrame, json_col: str = "json", keep: list[str] | None = None) -> DataFrame:
    """First entry's intensity: carbon_intensity (actual), forecast, status
    (index). An empty list gives NULLs (the reference raises)."""
    c = F.from_json(_c(json_col), CARBON_SCHEMA)
    first = F.get(c.getField("data"), 0).getField("intensity")
    return docs.select(*(keep or []),
                       first.getField("actual").alias("carbon_intensity"),
                       first.getField("forecast").alias("forecast"),
                       first.getField("index").alias("status"))


# ---------------------------------------------------------------- S7, J5, T3

LOAD_XML_SCHEMA = T.StructType([
    T.StructField("TimeSeries", T.ArrayType(T.StructType([
        T.StructField("Period", T.ArrayType(T.StructType([
            T.StructField("start", T.ArrayType(T.StringType())),
            T.StructField("quantity", T.ArrayType(T.StringType()))])))])))])


def _all_texts(doc: Column, field: str) -> Column:
    """Every ``field`` text under TimeSeries/Period, in document order, across
    every TimeSeries and Period (the reference searches ``.//``)."""
    periods = F.flatten(F.transform(F.coalesce(doc.getField("TimeSeries"), F.array()),
                                    lambda t: F.coalesce(t.getField("Period"), F.array())))
    empty = F.array().cast("array<string>")
    return F.flatten(F.transform(periods, lambda p: F.coalesce(p.getField(field), empty)))


def _load_pairs(docs: DataFrame, xml: Column, keep: list[str]) -> DataFrame:
    """``__p``: the n-th quantity paired with the n-th start (a missing start
    is NULL), one entry per quantity.

    ``from_xml`` (a streaming parser, several times faster than DOM-based
    ``xpath``) runs once per document: the parsed column is referenced twice
    and the quantity list twice, so the optimizer keeps each projection
    instead of inlining the parse into per-element expressions.
    """
    x = docs.select(*keep, F.from_xml(xml, LOAD_XML_SCHEMA).alias("__doc"))
    x = x.select(*keep, _all_texts(F.col("__doc"), "start").alias("start"),
                 _all_texts(F.col("__doc"), "quantity").alias("quantity"))
    zipped = F.slice(F.arrays_zip("quantity", "start"), 1, F.size("quantity"))
    return x.select(*keep, zipped.alias("__p"))


def grid_load(docs: DataFrame, xml_col: str = "xml", keep: list[str] | None = None) -> DataFrame:
    """One row per ``quantity`` of a load document (pos, load_ts,
    grid_demand_mw). Documents with no quantities give no rows."""
    x = _load_pairs(docs, _c(xml_col), keep or [])
    # the _outer generator: a plain one makes Spark infer size(__p) > 0 and
    # push it under the projection, parsing every document twice
    x = x.select(*(keep or []), F.posexplode_outer("__p").alias("pos", "p")).where(F.col("p").isNotNull())
    return x.select(*(keep or []), "pos",
                    F.col("p.start").try_cast("timestamp_ntz").alias("load_ts"),
                    F.col("p.quantity").try_cast("double").alias("grid_demand_mw"))


def grid_load_latest(docs: DataFrame, xml_col: str = "xml", keep: list[str] | None = None) -> DataFrame:
    """Last record of each load document (T3): a per-row projection, no
    shuffle; documents without records give no row."""
    x = _load_pairs(docs, _c(xml_col), keep or [])
    x = x.select(*(keep or []), F.explode_outer(F.slice("__p", -1, 1)).alias("p")).where(F.col("p").isNotNull())
    return x.select(*(keep or []),
                    F.col("p.start").try_cast("timestamp_ntz").alias("load_ts"),
                    F.col("p.quantity").try_cast("double").alias("grid_demand_mw"))


# ---------------------------------------------------------------- J2, P16

def weather_record(weather: DataFrame, solar_by_day: DataFrame, time_col: str = "observed_at") -> DataFrame:
    """The stored weather record: reading + that day's grid solar total
    (left equi-join on the day; P16 renames cloud_cover -> cloud_coverage and
    uses the grid total, not the estimate; 0 for a day without entries). The join strategy is left to
    AQE: the day table is broadcast only when its measured size allows."""
    w = weather.withColumn("__day", F.to_date(F.col(time_col)))
    s = solar_by_day.select(F.col("settlement_date").alias("__day"), "solar_generation")
    j = w.join(s, "__day", "left")
    return j.select(
        F.col(time_col).alias("timestamp"),
        *[c for c in weather.columns if c not in (time_col, "temperature", "wind_speed", "humidity",
                                                   "cloud_cover", "precipitation", "solar_estimate_kw")],
        "temperature", "wind_speed", "humidity",
        F.col("cloud_cover").alias("cloud_coverage"),
        F.coalesce("solar_generation", F.lit(0).cast("long")).alias("solar_generation"))
