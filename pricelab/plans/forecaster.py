"""The forecasting run as one stored object that takes raw rows.

``fit`` learns everything a prediction needs from a table of raw columns and keeps it as one Spark ML pipeline:

    fill and z-score the numbers -> index -> one-hot -> scale -> assemble -> boosted trees

and a linear model over windows of the assembled rows. Numbers are filled with the median of the train rows and
z-scored with their mean and population deviation (fixed in a ``SQLTransformer``); text that isn't a number counts as
missing. Categories are indexed alphabetically; a missing or unseen one is a row of zeros. One-hot columns
are divided by their population deviation but not centred, so the vectors stay sparse at any number of categories
(trees don't see a shift, and the linear model's intercept takes it up).

``score`` gives both models' predictions of raw rows, a table at a time; ``score_stream`` gives the same as rows land, with the
last rows of every series kept between micro-batches. A row without a time or key can't be placed and is rejected;
a row with fewer predecessors in its series than the window is long has a tree prediction only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelab.functions.names import time_columns
from pricelab.operators import series, stats
from pricelab.plans import forecast as fc
from pricelab.session import path_exists, remove_path, small_frame

#: Tail folders between two that hold every series (see ``score_stream``).
TAIL_EPOCHS = 32

#: Columns of the run's own frames.
RESERVED = {"features", "prediction", "label", "pos", "split", "split_pos", "fold"}

SCORED, SHORT, LATE, REJECTED = "scored", "short", "late", "rejected"


@dataclass
class Forecaster:
    """A fitted run: ``stages`` ends with the trees; ``meta`` holds the columns and the window's length."""

    stages: PipelineModel
    sequence: LinearRegressionModel
    meta: dict

    @property
    def tree(self) -> GBTRegressionModel:
        return self.stages.stages[-1]

    @property
    def place(self) -> list[str]:
        """The columns that place a row in its series."""
        return [self.meta["time"], *self.meta["key"]]

    def features(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector column ``features``."""
        made = PipelineModel(self.stages.stages[:-1]).transform(df)
        return made.select(*[F.col(f"`{c}`") for c in df.columns], "features")


# ------------------------------------------------------------------ fitting

def _number(col: str) -> str:
    return f"nanvl(try_cast(`{col}` AS DOUBLE), CAST(NULL AS DOUBLE))"


def _fill_stage(train: DataFrame, numeric: list[str], categorical: list[str]) -> SQLTransformer:
    """Frozen medians, means and deviations of the train rows as one SELECT."""
    numbers = train.select(*[F.expr(_number(c)).alias(f"n{i}") for i, c in enumerate(numeric)])
    names = numbers.columns
    parts = []
    if names:
        middle = stats.medians(numbers, names).first()            # one number a column
        middle = [0.0 if middle[f"{n}__median"] is None else middle[f"{n}__median"] for n in names]
        filled = numbers.select(*[F.coalesce(n, F.lit(m)).alias(n) for n, m in zip(names, middle)])
        row = filled.agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        for i, (c, m) in enumerate(zip(numeric, middle)):
            mean, spread = row[f"n{i}_m"] or 0.0, row[f"n{i}_s"] or 1.0
            parts.append(f"(coalesce({_number(c)}, double('{m!r}')) - double('{mean!r}')) / double('{spread!r}') AS __n{i}")
    parts += [f"CAST(`{c}` AS STRING) AS __c{i}" for i, c in enumerate(categorical)]
    return SQLTransformer(statement=f"SELECT {', '.join(['*', *parts])} FROM __THIS__")


def _encode_stages(train: DataFrame, numeric: list[str], categorical: list[str]) -> list:
    """The fitted stages from raw columns to ``features``."""
    fill = _fill_stage(train, numeric, categorical)
    stages: list = [fill]
    names = [f"__n{i}" for i in range(len(numeric))]
    if categorical:
        raw = [f"__c{i}" for i in range(len(categorical))]
        idx, hot = [f"{c}_idx" for c in raw], [f"{c}_hot" for c in raw]
        seen = fill.transform(train)
        indexer = StringIndexer(inputCols=raw, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc").fit(seen)
        # the index of missing and unseen values is the last one, which the encoder leaves out
        encoder = OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True).fit(indexer.transform(seen))
        joined = VectorAssembler(inputCols=hot, outputCol="__hot")
        own = joined.transform(encoder.transform(indexer.transform(seen)))
        found = own.agg(Summarizer.metrics("variance", "count").summary(F.col("__hot")).alias("s")).first()["s"]
        n = max(1, found["count"])
        scales = [1.0 / (v * (n - 1) / n) ** 0.5 if v > 0 else 1.0 for v in found["variance"].toArray().tolist()]
        stages += [indexer, encoder, joined, ElementwiseProduct(inputCol="__hot", outputCol="__hot_z", scalingVec=Vectors.dense(scales))]
        names.append("__hot_z")
    return [*stages, VectorAssembler(inputCols=names, outputCol="features")]


def feature_names(forecaster: Forecaster) -> list[str]:
    """Names by place in ``features``: the numbers, then ``column_value`` per category."""
    out = list(forecaster.meta["numeric"])
    for stage in forecaster.stages.stages:
        if type(stage).__name__ == "StringIndexerModel":
            out += [f"{c}_{v}" for c, labels in zip(forecaster.meta["categorical"], stage.labelsArray) for v in labels]
    return out


def raw_columns(df: DataFrame, target: str, exclude: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns: all but the target, the times and ``exclude``."""
    skip = {target, *time_columns(df), *exclude}
    own = [f for f in df.schema.fields if f.name not in skip]
    text = [f.name for f in own if f.dataType.typeName() in ("string", "boolean")]
    return [f.name for f in own if f.name not in text and f.dataType.typeName() in
            ("double", "float", "integer", "long", "short", "byte", "decimal")], text


def fit(df: DataFrame, target: str, key: list[str], time: str, series_cols: list[str] | None = None,
        numeric: list[str] | None = None, categorical: list[str] | None = None, test_size: float = fc.TEST_SIZE,
        length: int = fc.SEQUENCE_LENGTH, gbt_params: dict | None = None) -> tuple[Forecaster, DataFrame]:
    """The fitted run and its placed rows: ``key``, time, ``split``, ``split_pos``, ``fold``, ``label``, ``features`` (M1, M2).

    Rows without a time, key or target are left out; columns that hold no value in the train rows, too."""
    place = [time, *key]
    if numeric is None or categorical is None:
        found = raw_columns(df, target, [*place, *(series_cols or [])])
        numeric = found[0] if numeric is None else numeric
        categorical = found[1] if categorical is None else categorical
    taken = {c for c in [*place, *(series_cols or []), *numeric, *categorical] if c in RESERVED or c.startswith("__")}
    if taken:
        raise ValueError(f"rename these columns, their names are used by the run: {sorted(taken)}")
    known = df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    for c in place:
        known = known.where(F.col(c).isNotNull())
    s = series.chronological_split(known, place, test_size=test_size)
    s = series.hash_split(s, key, train_share=1 - fc.VALIDATION_SHARE, split_col="fold", labels=("fit", "validation")).checkpoint(eager=True)
    train = s.where(F.col("split") == "train")
    if categorical:
        held = train.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(categorical)]).first()
        categorical = [c for i, c in enumerate(categorical) if held[f"c{i}"]]
    stages = _encode_stages(train, numeric, categorical)
    meta = {"numeric": numeric, "categorical": categorical, "target": target, "key": key, "time": time,
            "series": list(series_cols or []), "length": length, "training_date": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")}
    made = PipelineModel(stages).transform(s)
    frame = made.select(*key, *dict.fromkeys([time, *meta["series"]]), "pos", "split", "split_pos", "fold", F.col(target).cast("double").alias("label"),
                        "features").checkpoint(eager=True)
    first = frame.select("features").first()
    if first is None:
        raise ValueError("no rows to fit on")
    meta["width"] = first["features"].size
    tree = fc.train_gbt(fc.Prepared(frame, numeric, target, key, None), gbt_params)
    # rows of a series must follow one another in the positions that windows are cut by
    lined = series.with_row_position(frame, ["split", *meta["series"], *place], "__pos") if meta["series"] else frame.withColumn("__pos", F.col("pos"))
    windows = _windows(lined, meta, "__pos", ["split", *meta["series"]]).where("__whole").checkpoint(eager=True)
    sequence = LinearRegression(featuresCol="__seq", labelCol="label", regParam=0.01, elasticNetParam=0.0).fit(windows.where(F.col("split") == "train"))
    return Forecaster(PipelineModel([*stages, tree]), sequence, meta), frame


def _windows(df: DataFrame, meta: dict, pos: str, parts: list[str]) -> DataFrame:
    """``df`` with ``__seq``, the ``length`` preceding feature rows of the same ``parts`` as one sparse vector (oldest first), and
    ``__whole``: whether all are there (else the vector is filled with the row's own features).

    ``pos`` is gap-free and the rows of each of ``parts`` follow one another in it; windows are cut in blocks of positions
    with a halo, so a series of any length is spread over tasks."""
    n = meta["length"]
    x = series._with_halo(df, pos, n, None)
    w = Window.partitionBy(*parts, "__block").orderBy(pos).rowsBetween(-n, -1)
    x = x.withColumn("__rows", F.collect_list("features").over(w)).where(F.col("__block") == F.col("__home")).drop("__home", "__block")
    size = {"ml_attr": {"num_attrs": meta["width"]}}
    x = x.withColumn("__whole", F.size("__rows") == n)
    cells = {f"__s{i}": F.coalesce(F.get("__rows", F.lit(i)), F.col("features")).alias(f"__s{i}", metadata=size) for i in range(n)}
    x = VectorAssembler(inputCols=list(cells), outputCol="__seq").transform(x.select("*", *cells.values()))
    return x.drop("__rows", *cells)


# ------------------------------------------------------------------ storing

def save(forecaster: Forecaster, path: str) -> None:
    """K5: the pipeline from raw columns to the trees, the sequence model and the metadata under one folder."""
    forecaster.stages.write().overwrite().save(f"{path}/pipeline")
    forecaster.sequence.write().overwrite().save(f"{path}/sequence")
    spark = SparkSession.active()
    small_frame(spark, [(json.dumps(forecaster.meta),)], "meta string").write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Forecaster:
    """K6: everything that raw rows need, loaded once and used for every batch."""
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["meta"])
    return Forecaster(PipelineModel.load(f"{path}/pipeline"), LinearRegressionModel.load(f"{path}/sequence"), meta)


# ------------------------------------------------------------------ scoring

def _raw(forecaster: Forecaster, df: DataFrame) -> DataFrame:
    """The columns of ``df`` that the run reads, with ``__series`` (never null) and ``__placed``."""
    m = forecaster.meta
    own = dict.fromkeys([*m["key"], m["time"], *m["series"], *m["numeric"], *m["categorical"]])
    placed = F.lit(True)
    for c in forecaster.place:
        placed = placed & F.col(c).isNotNull()
    return df.select(*own, F.struct(*(m["series"] or [F.lit(0).alias("none")])).alias("__series"), placed.alias("__placed"))


def _out(forecaster: Forecaster, df: DataFrame, tree: Column, sequence: Column, status: Column) -> DataFrame:
    m = forecaster.meta
    return df.select(*dict.fromkeys([*m["key"], m["time"], *m["series"]]), tree.alias("tree_predicted"), sequence.alias("sequence_predicted"),
                     F.when(tree.isNull(), F.lit(REJECTED)).otherwise(F.lit(SCORED)).alias("tree_status"), status.alias("sequence_status"))


def _predicted(forecaster: Forecaster, lined: DataFrame) -> DataFrame:
    """Both predictions of rows that carry ``features``, ``__series`` and ``__pos`` (see :func:`_windows`)."""
    w = _windows(lined, forecaster.meta, "__pos", ["__series"])
    w = forecaster.tree.transform(w).withColumnRenamed("prediction", "__tree")
    w = forecaster.sequence.transform(w).withColumnRenamed("prediction", "__sequence")
    return w.withColumn("__sequence", F.when(F.col("__whole"), F.col("__sequence")))


def _scored(forecaster: Forecaster, lined: DataFrame) -> DataFrame:
    return _out(forecaster, _predicted(forecaster, lined), F.col("__tree"), F.col("__sequence"),
                F.when(F.col("__whole"), F.lit(SCORED)).otherwise(F.lit(SHORT)))


def _rejected(forecaster: Forecaster, raw: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return _out(forecaster, raw.where(~F.col("__placed")), nothing, nothing, F.lit(REJECTED))


def score(forecaster: Forecaster, df: DataFrame) -> DataFrame:
    """Both models' predictions of raw rows: key, time, series columns, ``tree_predicted``, ``sequence_predicted``, ``tree_status``,
    ``sequence_status`` (scored, short: fewer predecessors than the window is long, rejected: no time or key)."""
    raw = _raw(forecaster, df)
    lined = series.with_row_position(forecaster.features(raw.where("__placed")), ["__series", *forecaster.place], "__pos")
    return _scored(forecaster, lined).unionByName(_rejected(forecaster, raw))


def score_after(forecaster: Forecaster, batch: DataFrame, tails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores of ``batch``, new tails): as :func:`score`, going on after the last rows of every series in ``tails``.

    ``tails`` and the new ones hold ``__series``, the place columns and ``features`` of up to a window's length of rows a series;
    the new ones are those of the series that ``batch`` holds. A row that isn't after its series' last row is late: it gets
    a tree prediction only and leaves the tails as they are."""
    m, place = forecaster.meta, F.struct(*forecaster.place)
    raw = _raw(forecaster, batch)
    rows = forecaster.features(raw.where("__placed"))
    last = tails.groupBy("__series").agg(F.max(place).alias("__last"))
    rows = rows.join(last, "__series", "left").withColumn("__late", F.coalesce(place <= F.col("__last"), F.lit(False))).drop("__last")
    rows = rows.checkpoint(eager=True)                                       # features are computed once
    fresh = rows.where("NOT __late")
    before = tails.join(fresh.select("__series").distinct(), "__series", "left_semi").withColumn("__old", F.lit(True))
    both = fresh.withColumn("__old", F.lit(False)).unionByName(before, allowMissingColumns=True)
    lined = series.with_row_position(both, ["__series", *forecaster.place], "__pos")
    ends = lined.groupBy("__series").agg(F.max("__pos").alias("__end"))
    kept = lined.join(ends, "__series").where(F.col("__pos") > F.col("__end") - m["length"]).select("__series", *forecaster.place, "features")
    scored = _predicted(forecaster, lined).where("NOT __old")
    fresh_out = _out(forecaster, scored, F.col("__tree"), F.col("__sequence"), F.when(F.col("__whole"), F.lit(SCORED)).otherwise(F.lit(SHORT)))
    late = forecaster.tree.transform(rows.where("__late"))
    late_out = _out(forecaster, late, F.col("prediction"), F.lit(None).cast("double"), F.lit(LATE))
    return fresh_out.unionByName(late_out).unionByName(_rejected(forecaster, raw)), kept


def _tails(path: str, epoch: int, every: int, like: DataFrame) -> DataFrame:
    """Every series' tail after the epochs before ``epoch``: the newest folder's, from the last whole folder on."""
    spark = like.sparkSession
    first = max(0, epoch // every * every - 1)
    found = [p for e in range(first, epoch) if path_exists(spark, p := f"{path}/epoch={e}")]
    if not found:
        return like.limit(0)
    rows = spark.read.option("basePath", path).parquet(*found)
    newest = rows.groupBy("__series").agg(F.max("epoch").alias("__newest"))
    return rows.join(newest, "__series").where("epoch = __newest").drop("epoch", "__newest")


def score_stream(forecaster: Forecaster, stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True,
                 interval: str = "15 minutes", tail_epochs: int = TAIL_EPOCHS):
    """S9/M6 on a stream: scores raw rows as they land, to ``{out_path}/epoch={id}`` (a replay writes the same folder).

    The state is a table of tails under the checkpoint: each micro-batch writes those of the series it holds, every
    ``tail_epochs``-th those of all series, so a batch reads at most that many folders and older ones are removed.
    Nothing is held in an executor between batches; a replayed batch reads the tails of the batches before it only."""
    tails_path = f"{checkpoint.rstrip('/')}/tails"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        like = forecaster.features(_raw(forecaster, batch)).select("__series", *forecaster.place, "features")
        tails = _tails(tails_path, epoch, tail_epochs, like)
        out, new = score_after(forecaster, batch, tails)
        out.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        if epoch % tail_epochs == tail_epochs - 1:
            new = new.unionByName(tails.join(new.select("__series").distinct(), "__series", "left_anti"))
        new.write.mode("overwrite").parquet(f"{tails_path}/epoch={epoch}")
        if epoch % tail_epochs == 0:
            for e in range(max(0, epoch - 2 * tail_epochs - 1), epoch - 1):
                remove_path(spark, f"{tails_path}/epoch={e}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
