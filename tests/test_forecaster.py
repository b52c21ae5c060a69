"""The stored run from raw rows, its stream, gain importances, and split labels without a sort."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from pricelab.operators import encode, series
from pricelab.plans import forecast as fc
from pricelab.plans import forecaster as fo
from pricelab.session import scratch_path

RAW = "id long, at timestamp_ntz, shop string, kind string, size string, price double"
START = dt.datetime(2024, 1, 1)
TREES = dict(maxIter=3, maxDepth=3)


def _rows(n, kinds=5, seed=3):
    """n rows of two shops, one of which holds two thirds of them; gaps in every feature."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = None if i % 17 == 0 else f"k{r.randrange(kinds)}"
        size = None if i % 13 == 0 else "many" if i % 29 == 0 else str(r.randrange(100))
        out.append((i, START + dt.timedelta(minutes=i), "hot" if i % 3 else None, kind, size, 5.0 * (int(kind[1:]) if kind else 0) + r.random() + 0.01 * i))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(_rows(400), RAW)
    return fo.fit(df, "price", ["id"], "at", ["shop"], ["size"], ["kind"], length=4, gbt_params=TREES)


def _by_id(df):
    return {r.id: (r.tree_status, r.sequence_status, r.tree_predicted, r.sequence_predicted) for r in df.collect()}


def _same(a, b):
    assert a.keys() == b.keys()
    for k, (ts, ss, t, s) in a.items():
        assert (ts, ss) == b[k][:2]
        assert all((x is None and y is None) or x == pytest.approx(y, rel=1e-9) for x, y in zip((t, s), b[k][2:]))


def test_features_are_filled_scaled_and_encoded(spark, fitted):
    run, frame = fitted
    assert fo.feature_names(run) == ["size", *[f"kind_k{i}" for i in range(5)]]
    train = frame.where("split = 'train'").collect()
    width = len(fo.feature_names(run))
    for i in range(width):
        own = [r.features.toArray()[i] for r in train]
        mean = sum(own) / len(own)
        spread = math.sqrt(sum((v - mean) ** 2 for v in own) / len(own))
        assert spread == pytest.approx(1) and (i > 0 or mean == pytest.approx(0, abs=1e-9))
    odd = spark.createDataFrame([(1, START, None, "never", None, None), (2, START, None, None, "x", None)], RAW)
    got = [r.features.toArray() for r in run.features(odd).collect()]
    numbers = sorted(float(r[4]) for r in _rows(400)[:320] if r[4] not in (None, "many"))
    middle = (numbers[(len(numbers) - 1) // 2] + numbers[len(numbers) // 2]) / 2
    filled = [float(r[4]) if r[4] not in (None, "many") else middle for r in _rows(400)[:320]]
    mean = sum(filled) / 320
    want = (middle - mean) / math.sqrt(sum((v - mean) ** 2 for v in filled) / 320)
    assert all(v[0] == pytest.approx(want) and not v[1:].any() for v in got)


def test_windows_are_those_of_the_series(spark, fitted):
    """The sequence model's prediction from the four preceding rows of the same shop, recomputed by hand."""
    run, _ = fitted
    df = spark.createDataFrame(_rows(120, seed=9), RAW).repartition(7)
    rows = sorted(run.features(df).collect(), key=lambda r: r.at)
    got = _by_id(fo.score(run, df))
    for shop in ("hot", None):
        own = [r for r in rows if r.shop == shop]
        for i, r in enumerate(own):
            assert got[r.id][1] == (fo.SCORED if i >= 4 else fo.SHORT)
            if i >= 4:
                window = [v for p in own[i - 4: i] for v in p.features.toArray()]
                assert got[r.id][3] == pytest.approx(run.sequence.intercept + sum(a * b for a, b in zip(window, run.sequence.coefficients.toArray())))
            else:
                assert got[r.id][3] is None and got[r.id][2] is not None


def test_stored_run_scores_as_before(spark, fitted):
    run, _ = fitted
    path = scratch_path(spark, "forecaster-test")
    fo.save(run, path)
    rows = _rows(60, kinds=9, seed=4) + [(900, None, "hot", "k1", "1", 0.0), (None, START, "hot", "k1", "1", 0.0)]
    df = spark.createDataFrame(rows, RAW)
    loaded = fo.load(spark, path)
    assert loaded.meta == run.meta and fo.feature_names(loaded) == fo.feature_names(run)
    got = _by_id(fo.score(loaded, df))
    _same(got, _by_id(fo.score(run, df)))
    assert got[900] == got[None] == (fo.REJECTED, fo.REJECTED, None, None)
    assert fo.score(loaded, df.limit(0)).count() == 0


def test_stream_goes_on_after_the_tails(spark, fitted):
    """Seven batches (some without one of the shops, one empty), a restart before each, against one batch over all."""
    run, _ = fitted
    root, rows = scratch_path(spark, "forecaster-stream"), _rows(140, seed=5)
    df = spark.createDataFrame(rows, RAW)
    cuts = [0, 3, 40, 41, 90, 91, 120, 140]
    for lo, hi in zip(cuts, cuts[1:]):
        part = df.where((F.col("id") >= lo) & (F.col("id") < hi))
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{root}/in")
        fo.score_stream(run, stream, f"{root}/out", f"{root}/ckpt", tail_epochs=2).awaitTermination()
    _same(_by_id(spark.read.parquet(f"{root}/out")), _by_id(fo.score(run, df)))
    assert len([p for p in os.listdir(f"{root}/ckpt/tails".removeprefix("file:")) if p.startswith("epoch=")]) < 7


def test_late_rows_leave_the_windows_alone(spark, fitted):
    run, _ = fitted
    rows = [(i, START + dt.timedelta(minutes=i), "a", "k1", "1", 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, RAW)
    none = run.features(fo._raw(run, df)).select("__series", *run.place, "features").limit(0)
    _, tails = fo.score_after(run, df.where("id < 8"), none)
    late = spark.createDataFrame([(100, START, "a", "k2", "9", 0.0)], RAW)
    out, after = fo.score_after(run, df.where("id >= 8").union(late), tails)
    got = _by_id(out)
    assert got[100][:2] == (fo.SCORED, fo.LATE) and got[100][3] is None
    whole = _by_id(fo.score(run, df))
    _same({k: v for k, v in got.items() if k != 100}, {k: v for k, v in whole.items() if k >= 8})
    assert sorted(r.id for r in after.collect()) == [8, 9, 10, 11]


def test_wide_categories_go_through_both_models(spark):
    """Hundreds of categories stay sparse from the fit to the scoring; the width is that of the fit."""
    rows = [(i, START + dt.timedelta(minutes=i), None, f"c{i * 7919 % 600}", "1", float(i % 7)) for i in range(900)]
    df = spark.createDataFrame(rows, RAW)
    run, frame = fo.fit(df, "price", ["id"], "at", None, [], ["kind"], length=3, gbt_params=dict(maxIter=1, maxDepth=2))
    seen = {f"c{i * 7919 % 600}" for i in range(720)}
    assert run.meta["width"] == len(seen) and run.sequence.numFeatures == 3 * len(seen)
    new = spark.createDataFrame([(1000 + i, START + dt.timedelta(days=9, minutes=i), None, f"z{i}", None, None) for i in range(9)], RAW)
    vectors = [r.features for r in run.features(new).collect()]
    assert all(v.size == len(seen) and v.numNonzeros() == 0 for v in vectors)
    assert all(type(r.features).__name__ == "SparseVector" for r in frame.limit(5).collect())
    assert fo.score(run, new).where("sequence_status = 'scored'").count() == 6


def test_fit_refuses_what_it_cannot_use(spark):
    df = spark.createDataFrame(_rows(5), RAW)
    with pytest.raises(ValueError, match="no rows"):
        fo.fit(df.limit(0), "price", ["id"], "at", gbt_params=TREES, numeric=["size"], categorical=[])
    with pytest.raises(ValueError, match="rename"):
        fo.fit(df.withColumnRenamed("size", "features"), "price", ["id"], "at", numeric=["features"], categorical=[])


def test_raw_columns_leave_out_target_times_and_keys(spark):
    df = spark.createDataFrame(_rows(3), RAW).withColumn("flag", F.lit(True)).withColumn("n", F.lit(1))
    assert fo.raw_columns(df, "price", ["id", "at"]) == (["n"], ["shop", "kind", "size", "flag"])


def test_one_hot_long_lists_every_entry(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", None, "b"])], "k long, c string")
    x, model = encode.one_hot_vector(df, "c")
    assert sorted(map(tuple, encode.one_hot_long(x, "c_vec", ["k"]).collect())) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0), (3, 1, 1.0)]


def test_prepare_fills_missing_features_from_train(spark):
    rows = [(i, START + dt.timedelta(minutes=i), None if i in (3, 97) else float("nan") if i == 5 else float(i % 9), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, x double, y double")
    prep = fc.prepare(df, ["x"], "y", ["k"], ["t", "k"])
    own = sorted(float(i % 9) for i in range(80) if i not in (3, 5))
    raw = {r.k: r.xraw[0] for r in prep.frame.collect()}
    assert raw[3] == raw[5] == raw[97] == (own[38] + own[39]) / 2 and len(raw) == 100


def test_gain_importance_equals_a_walk_over_the_trees(spark, fitted):
    run, _ = fitted
    names = fo.feature_names(run)
    gains = {}

    def walk(node):
        if node.numDescendants() == 0:
            return
        at = node.split().featureIndex()
        gains.setdefault(names[at], []).append(node.gain() * node.impurityStats().count())
        walk(node.leftChild())
        walk(node.rightChild())

    for tree in run.tree.trees:
        walk(tree._call_java("rootNode"))
    got = {r.feature: (r.gain, r.splits) for r in fc.gain_importance(run.tree, names, top=99).collect()}
    assert got.keys() == set(names)
    for c in names:
        assert got[c][1] == len(gains.get(c, [])) and got[c][0] == pytest.approx(sum(gains.get(c, [])) / max(1, len(gains.get(c, []))))
    assert [r.gain for r in fc.gain_importance(run.tree, names, top=3).collect()] == sorted((g for g, _ in got.values()), reverse=True)[:3]


def test_tree_tasks_follow_the_rows_not_the_partitions(spark, fitted, monkeypatch):
    """Two trees over a frame in 60 partitions: no stage after the rows are dealt out has a task per partition."""
    _, frame = fitted
    sc = spark.sparkContext
    wide = frame.repartition(60).checkpoint(eager=True)

    def tasks(group):
        sc.setJobGroup(group, group)
        model = fc.train_gbt(fc.Prepared(wide, ["size"], "price", ["id"], None), dict(maxIter=2, maxDepth=2))
        sc.setJobGroup("", "")
        assert model.getNumTrees == 2
        stages = {i for j in sc.statusTracker().getJobIdsForGroup(group) for i in sc.statusTracker().getJobInfo(j).stageIds}
        return [info.numTasks for i in stages if (info := sc.statusTracker().getStageInfo(i)) and info.numCompletedTasks]  # not the skipped ones

    assert sum(n >= 60 for n in tasks("few rows")) <= 2                      # the count, and the rows dealt out
    monkeypatch.setattr(fc, "MANY_ROWS", 50)
    n = frame.where("split = 'train' AND fold = 'fit'").count()
    assert max(n for n in tasks("more rows than a partition takes") if n < 60) == -(-n // 50)
    dealt = fc._spread(frame.where("split = 'train' AND fold = 'fit'").select("label", "features"))
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) <= 50 + 60


@pytest.mark.parametrize("range_rows", [1, 40, 10_000])
def test_rows_at_ranks_equal_a_sort(spark, range_rows):
    """Hot times (a third of the rows share one), nulls, and ranks beyond the table."""
    r = random.Random(1)
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else r.randrange(400), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "t int, k long").repartition(5)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ranks = [0, 1, 300, 301, 959, 1199, 1200, -1]
    got = series.rows_at_ranks(df, ["t", "k"], ranks, range_rows).first()
    assert [tuple(got[f"r{i}"]) if got[f"r{i}"] else None for i in range(8)] == [want[x] if 0 <= x < 1200 else None for x in ranks]
    equal = spark.createDataFrame([(5, 5)] * 300, "t int, k long")
    assert tuple(series.rows_at_ranks(equal, ["t", "k"], [150], range_rows).first()[0]) == (5, 5)


@pytest.mark.parametrize("n", [0, 1, 2, 30, 100])
def test_labels_equal_the_split_by_position(spark, n):
    df = spark.createDataFrame([(i // 3, i) for i in range(n)], "t int, k long").repartition(4)
    by_pos = {r.k: (r.split, r.split_pos >= 4) for r in series.chronological_split(df, ["t", "k"]).collect()}
    got = series.split_labels(df, ["t", "k"], preceded_by=4)
    assert {r.k: (r.split, r.preceded) for r in got.collect()} == by_pos and got.columns == ["t", "k", "split", "preceded"]
    n_train = math.floor(n * 0.8)
    n_fit = math.floor(n_train * 0.8)
    want = {k: "fit" if k < n_fit else "validation" if k < n_train else "test" for k in range(n)}
    assert {r.k: r.split for r in series.validation_split(df, ["t", "k"]).collect()} == want


def test_split_labels_do_not_sort(spark):
    df = spark.range(100).selectExpr("id AS k", "id % 7 AS t")
    plan = series.split_labels(df, ["t", "k"], preceded_by=3)._jdf.queryExecution().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan
