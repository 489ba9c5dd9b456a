"""Mergeable least-squares states: precision at high levels, many features, keys, merging in any order."""

import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import d
from tidewatch.config import RollingConfig
from tidewatch.operators import dataset, factors, rolling

DAY0 = date(2000, 1, 1)


def numpy_fit(x, y):
    """On standardised features, as (intercept, slopes) of the features as they are, with the residual deviation."""
    mu, sd = x.mean(axis=0), x.std(axis=0)
    a = np.column_stack([np.ones(len(x)), (x - mu) / sd])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    slopes = b[1:] / sd
    return np.concatenate([[b[0] - slopes @ mu], slopes]), (y - a @ b).std()


@pytest.mark.parametrize(("level", "spread"), [(1e4, 1e-3), (1e5, 1e-2), (1e7, 1.0), (1e10, 1.0), (0.0, 1e-9), (-1e7, 3.0)])
def test_precision_at_any_level(spark, level, spread):
    rng = np.random.default_rng(3)
    n = 900
    x = level + spread * rng.normal(size=(n, 2))
    y = level + 0.5 * (x[:, 0] - level) - 2 * (x[:, 1] - level) + spread * rng.normal(size=n)
    release = [DAY0 + timedelta(days=int(i) + int(rng.integers(0, 90))) for i in range(n)]
    rows = [(DAY0 + timedelta(days=i), float(y[i]), release[i], float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    ds = spark.createDataFrame(rows, "origin_date date, y double, model_target_release_date date, x_a double, x_b double").repartition(5)
    cfg, xs = RollingConfig(test_start="2001-01-01", window_years=1), ["x_a", "x_b"]
    found = {r["refit_date"]: r for r in rolling.fits(ds, xs, cfg).collect()}
    sigmas = {(r["refit_date"], r["distance_bucket"]): r["sigma"] for r in rolling.stage_sigmas(ds, xs, cfg).collect()}
    scores = {r["refit_date"]: r for r in rolling.zscore_params(ds, xs, cfg).collect()}
    assert len(found) == 18
    exact = 1e-6 if level < 1e9 else 1e-4  # there the values themselves have no more digits
    for refit, r in found.items():
        own = [i for i, row in enumerate(rows) if refit.replace(year=refit.year - 1) <= row[0] < refit]
        b, sd = numpy_fit(x[own], y[own])
        assert r["coef"][1:] == pytest.approx(b[1:].tolist(), rel=exact)
        assert sigmas[refit, None] == pytest.approx(sd, rel=exact)
        assert [scores[refit]["sd_x_a"], scores[refit]["sd_x_b"]] == pytest.approx(x[own].std(axis=0).tolist(), rel=exact)
        residual = y[own] - x[own] @ b[1:]
        for stage in ("early", "mid", "late"):
            inside = [k for k, i in enumerate(own) if stage == ("early" if (rows[i][2] - rows[i][0]).days >= 61 else "mid" if (rows[i][2] - rows[i][0]).days >= 21 else "late")]
            assert sigmas[refit, stage] == pytest.approx(residual[inside].std(), rel=exact)
    preds = rolling.run_rolling(ds, cfg, xs)
    assert preds.where("nowcast_sigma is null or nowcast_sigma <= 0 or ci_high_95 <= ci_low_95").count() == 0


def test_precision_of_single_models(spark):
    rng = np.random.default_rng(4)
    x = 1e7 + rng.normal(size=400)
    df = spark.createDataFrame([(float(v), float(3 * (v - 1e7) + 1), "early") for v in x], "x double, y double, distance_bucket string")
    assert rolling.LinearModel().fit(df, ["x"]).coefficients[1] == pytest.approx(3, rel=1e-6)


def test_states_merge_in_any_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [1, 1e3, 1e-3, 1] + [0, 1e6, 0, 5]
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:40, 1] = np.nan
    x[:, 3] = 0.1  # does not vary
    y = rng.normal(size=300)
    whole = factors.State.of(x, y)
    for cuts in ([1, 2, 3, 299], [40, 41, 150], [100, 200]):
        parts = [factors.State.of(a, b) for a, b in zip(np.split(x, cuts), np.split(y, cuts), strict=True)]
        while len(parts) > 1:
            parts = [a.merge(b) if b is not None else a for a, b in zip(parts[::2], [*parts[1::2], *([None] * (len(parts) % 2))], strict=True)]
        got = factors.State.unpack(parts[0].pack())
        assert (got.n_rows, got.n) == (whole.n_rows, whole.n) and got.known.tolist() == whole.known.tolist()
        assert got.mu == pytest.approx(whole.mu, rel=1e-12) and got.spread()[:3] == pytest.approx(np.nanstd(x[:, :3], axis=0), rel=1e-9)
        assert np.isnan(got.spread()[3]) and got.solve() is None
        assert got.r.T @ got.r == pytest.approx(whole.r.T @ whole.r, rel=1e-9, abs=1e-9)
    assert factors.State.of(x[:0], y[:0]).merge(whole).n == whole.n and whole.merge(factors.State.of(x[:0], y[:0])).n == whole.n


def test_windows_slide():
    rng = np.random.default_rng(6)
    x, y, month = rng.normal(size=(500, 2)), rng.normal(size=500), rng.integers(0, 40, 500)
    month[month == 17] = 18
    by = {int(m): factors.State.of(x[month == m], y[month == m]) for m in np.unique(month)}
    for length in (1, 3, 12, 50):
        lows = list(range(-5, 41))
        for lo, s in zip(lows, factors.slide(by, lows, length), strict=True):
            own = (month >= lo) & (month < lo + length)
            assert (0 if s is None else s.n) == own.sum()
            if own.sum() > 5:
                assert s.solve() == pytest.approx(factors.State.of(x[own], y[own]).solve(), rel=1e-9)


def test_three_hundred_features(spark):
    """As many features as there are, in one array column: the plan has as many operators as with three."""
    rng = np.random.default_rng(7)
    n, k = 1826, 300
    x = rng.normal(size=(n, k)) + 1e4
    y = x @ rng.normal(size=k) + rng.normal(size=n)
    ds = spark.createDataFrame([(DAY0 + timedelta(days=i), float(y[i]), x[i].tolist()) for i in range(n)], "origin_date date, y double, features array<double>").repartition(4).cache()
    ds.count()
    cfg = RollingConfig(test_start="2004-01-01", window_years=3)
    began = time.perf_counter()
    found = {r["refit_date"]: r for r in rolling.fits(ds, "features", cfg).collect()}
    took = time.perf_counter() - began
    assert len(found) == 12
    for refit in (d("2004-01-01"), d("2004-12-01")):
        own = [i for i in range(n) if refit.replace(year=refit.year - 3) <= DAY0 + timedelta(days=i) < refit]
        b, sd = numpy_fit(x[own], y[own])
        assert found[refit]["coef"][1:] == pytest.approx(b[1:].tolist(), rel=1e-6, abs=1e-8) and found[refit]["sigma"] == pytest.approx(sd, rel=1e-6)
    preds = rolling.run_rolling(ds, cfg)
    assert preds.where("y_hat is not null and nowcast_sigma > 0").count() == 365

    def operators(frame):
        return frame._jdf.queryExecution().executedPlan().toString().count("\n")

    few = ds.withColumn("features", F.slice("features", 1, 3))
    assert abs(operators(preds) - operators(rolling.run_rolling(few, cfg))) <= 1
    assert took < 20, took


def test_keys_and_packed_datasets(spark):
    rng = np.random.default_rng(8)
    rows = []
    for key, slope in (("a", 1.0), ("b", -2.0), (None, 5.0)):
        for i in range(500):
            v = float(rng.normal())
            rows.append((key, DAY0 + timedelta(days=i), slope * v + 3, v, 7))
    ds = spark.createDataFrame(rows, "entity string, origin_date date, y double, x_a double, month int")
    cfg = RollingConfig(test_start="2001-01-10", window_years=1)
    found = rolling.coefficients(ds, ["x_a"], cfg, keys=["entity"]).collect()
    assert {r["entity"] for r in found} == {"a", "b", None} and len(found) == 3 * 5
    assert {round(r["b_1"], 8) for r in found if r["entity"] is None} == {5.0}
    packed = ds.select("entity", "origin_date", "y", F.array("x_a").alias(dataset.PACKED))
    assert [r["coef"] for r in rolling.fits(packed.where("entity = 'b'"), dataset.PACKED, cfg).collect()] == [pytest.approx([3, -2])] * 5
    assert rolling.run_rolling(packed.where("false"), cfg).count() == 0


def test_packed_bridge_dataset_equals_columns(spark):
    from tests.conftest import SMALL
    from tidewatch.plans.queries import nowcaster

    n = nowcaster(spark, SMALL)
    wide = n.dataset(min_features=3)
    xs = dataset.feature_columns(wide)
    packed = n.dataset(packed=True, min_features=3)
    assert packed.columns[-1] == dataset.PACKED
    assert wide.select("origin_date", "y", F.array(*xs).alias("v")).exceptAll(packed.select("origin_date", "y", "features")).count() == 0
    assert packed.count() == wide.count() > 100
