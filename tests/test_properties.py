"""Property tests: the distributed operators against brute force
on small generated inputs."""

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelab.operators import series, stats

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float),
                            st.floats(-1e3, 1e3, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=60)


def _frame(spark, vals):
    pdf = pd.DataFrame({"k": range(len(vals)), "x": pd.array(vals, dtype="Float64")})
    return spark.createDataFrame([(int(k), None if v is None else float(v)) for k, v in zip(pdf.k, vals)],
                                 "k long, x double")


def test_quantile_ranges_stay_bounded(spark, monkeypatch):
    """With two cuts a round and many distinct values, what is sorted at the end is small and the answer exact."""
    monkeypatch.setattr(stats, "RANGE_VALUES", 100)
    seen = []
    plain = stats._in_ranges
    monkeypatch.setattr(stats, "_in_ranges", lambda s, vc, t: seen.append([dict(x) for x in t]) or plain(s, vc, t))
    df = spark.range(20_000).selectExpr("cast((id * 7919) % 20011 as double) as x")
    row = stats.quantiles_by_column(df, ["x"], [0.25, 0.5], buckets=4).first()
    vals = np.array([(i * 7919) % 20011 for i in range(20_000)], dtype=float)
    assert [row.q0, row.q1] == np.quantile(vals, [0.25, 0.5]).tolist()
    assert len(seen) > 2 and all(t["values"] <= 100 for t in seen[-1])


@SETTINGS
@given(vals=values, buckets=st.sampled_from([1, 3, 64]))
def test_exact_quantiles_match_numpy(spark, vals, buckets):
    df = _frame(spark, vals)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    row = stats.quantiles_by_column(df, ["x"], probs, buckets=buckets).collect()
    present = np.array([v for v in vals if v is not None], dtype=float)
    if present.size == 0:
        assert row == [] or row[0]["q0"] is None
        return
    expect = np.quantile(present, probs)  # linear interpolation, as pandas
    got = [row[0][f"q{i}"] for i in range(len(probs))]
    assert row[0]["n"] == present.size
    for g, e in zip(got, expect):
        assert math.isclose(g, e, rel_tol=1e-9, abs_tol=1e-9)


@SETTINGS
@given(vals=values)
def test_impute_median_leaves_no_gaps(spark, vals):
    out = stats.impute_median(_frame(spark, vals), ["x"])
    present = [v for v in vals if v is not None]
    nulls = out.where(F.col("x").isNull()).count()
    assert nulls == (len(vals) if not present else 0)


@SETTINGS
@given(n=st.integers(30, 200), length=st.integers(1, 8), block=st.integers(8, 40))
def test_block_halo_windows_equal_global_window(spark, n, length, block):
    rng = np.random.default_rng(n)
    xs = rng.normal(size=n).round(3).tolist()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(xs)], "pos long, v double")
    w = series.sequence_windows(df, ["v"], "v", length=length, pos_col="pos", block_rows=max(block, length))
    got = {r["pos"]: [a[0] for a in r["sequence"]] for r in w.collect()}
    assert sorted(got) == list(range(length, n))
    for i, seq in got.items():
        assert seq == xs[i - length:i]


@SETTINGS
@given(n=st.integers(5, 120), ties=st.integers(1, 5))
def test_positions_and_split_sizes(spark, n, ties):
    rows = [(i, i // ties) for i in range(n)]  # many rows share a time value
    df = spark.createDataFrame(rows, "k long, t long")
    s = series.chronological_split(df, ["t", "k"], test_size=0.2)
    got = sorted((r["k"], r["pos"], r["split"]) for r in s.collect())
    assert [p for _, p, _ in got] == list(range(n))
    n_train = int(n * (1 - 0.2))
    assert sum(1 for *_, sp in got if sp == "train") == n_train
    assert all((sp == "train") == (p < n_train) for _, p, sp in got)


def test_scaled_train_has_mean_zero_std_one(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(3)) for i in range(100)], "k long, a double, c double")
    sc = stats.fit_standard_scaler(df, ["a", "c"])
    out = stats.apply_standard_scaler(df, sc, ["a", "c"], suffix="_z").toPandas()
    assert abs(out.a_z.mean()) < 1e-12
    assert abs(out.a_z.std(ddof=0) - 1) < 1e-12
    assert (out.c_z == 0).all()  # constant feature: std 0 -> divide by 1


def test_lags_equal_shifted_series(spark):
    xs = [float(i * i % 11) for i in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(xs)], "pos long, v double")
    out = series.lag_features(df, ["v"], [1, 3], block_rows=7).orderBy("pos").toPandas()
    assert out.v_lag1.tolist()[1:] == xs[:-1] and pd.isna(out.v_lag1[0])
    assert out.v_lag3.tolist()[3:] == xs[:-3] and out.v_lag3[:3].isna().all()


def test_hash_split_share(spark):
    df = spark.range(10000).withColumnRenamed("id", "k")
    n_train = series.hash_split(df, ["k"]).where("split = 'train'").count()
    assert 7700 < n_train < 8300


def test_binned_density_close_to_exact_kde(spark):
    from pricelab.operators.profiles import kernel_density

    rng = np.random.default_rng(7)
    xs = np.concatenate([rng.normal(0, 1, 3000), rng.normal(5, 0.5, 1000)])
    df = spark.createDataFrame([(float(v),) for v in xs], "x double")
    got = kernel_density(df, "x").orderBy("grid_i").toPandas()
    n, sd = xs.size, xs.std(ddof=1)
    bw = sd * n ** -0.2
    exact = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - xs[None, :]) / bw) ** 2).sum(1) / (n * bw * np.sqrt(2 * np.pi))
    assert len(got) == 200
    assert np.max(np.abs(got.density.to_numpy() - exact)) < 1e-3 * exact.max()
    assert abs(np.trapezoid(got.density.to_numpy(), got.x.to_numpy()) - 1) < 1e-2


def test_density_of_heavy_tails(spark):
    from pricelab.operators.profiles import kernel_density

    xs = np.random.default_rng(3).standard_t(2, 20_000)
    df = spark.createDataFrame([(float(v),) for v in xs], "x double")
    got = kernel_density(df, "x").orderBy("grid_i").toPandas()
    bw = xs.std(ddof=1) * xs.size ** -0.2
    exact = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - xs[None, :]) / bw) ** 2).sum(1) / (xs.size * bw * np.sqrt(2 * np.pi))
    assert np.max(np.abs(got.density.to_numpy() - exact)) < 2e-3 * exact.max()
