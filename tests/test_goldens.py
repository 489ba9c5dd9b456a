"""Values worked out by hand for the points where semantics are easy to get wrong."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import d
from tidewatch.config import ARConfig, RollingConfig, SeriesMeta, load_series_meta, parse_series_meta
from tidewatch.functions import dates, labels
from tidewatch.functions.metrics import metrics
from tidewatch.operators import autoregression, dataset, evaluation, features, linalg, panel, rolling, signals
from tidewatch.operators.calendar import add_calendar, build_calendar, unknown_series
from tidewatch.operators.checks import calendar_violations, integrity

CAL = "series string, ref_period date, vintage_date date, value double, available_date date"


def meta(**kw):
    return SeriesMeta(**({"name": "s", "vendor": "v", "code": "C", "freq": "Q", "release_rule": "r", "release_lag_days": 27} | kw))


def cal(spark, *rows):
    return spark.createDataFrame([(r[0], d(r[1]), d(r[2]), r[3], d(r[4])) for r in rows], CAL)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vintage_policies_and_strict_mode(spark):
    raw = spark.createDataFrame([("g", d("2020-01-01"), d("2020-04-29"), 1.0), ("g", d("2020-01-01"), d("2020-05-28"), 2.0)], "series string, ref_period date, vintage_date date, value double")
    metas = {"g": meta()}
    base = build_calendar(raw, metas)
    assert {r["available_date"] for r in base.collect()} == {d("2020-04-27")}
    last = panel.daily_panel(base, "2020-04-26", "2020-04-28").orderBy("as_of_date").collect()
    assert [r["value"] for r in last] == [None, 2.0, 2.0]
    assert autoregression.quarterly_targets(base).first()["y"] == 1.0
    strict = build_calendar(raw, metas, strict=True)
    assert {r["available_date"] for r in strict.collect()} == {d("2020-04-29"), d("2020-05-28")}
    assert {r["series"]: r["before_vintage"] for r in calendar_violations(base).collect()} == {"g": 2}
    assert panel.daily_panel(panel.pick_vintages(base, "first_release"), "2020-04-27", "2020-04-27").first()["value"] == 1.0


def test_events_before_the_start_are_not_carried_in(spark):
    c = cal(spark, ("a", "2019-11-01", None, 1.0, "2019-12-30"), ("a", "2019-12-01", None, 3.0, "2020-01-05"))
    assert [r["value"] for r in panel.daily_panel(c, "2020-01-01", "2020-01-06").orderBy("as_of_date").collect()] == [None] * 4 + [3.0, 3.0]
    assert [r["value"] for r in panel.daily_panel(c, "2020-01-01", "2020-01-06", carry_in=True).orderBy("as_of_date").collect()] == [1.0] * 4 + [3.0, 3.0]


def test_columns_are_carried_forward_on_their_own(spark):
    c = cal(spark, ("a", "2019-10-01", None, 1.0, "2020-01-01"), ("a", "2019-11-01", None, None, "2020-01-02"), ("a", "2019-12-01", None, 3.0, "2020-01-05"))
    days = panel.daily_panel(c, "2020-01-01", "2020-01-05")
    got = {str(r["as_of_date"]): (r["value"], str(r["ref_period"])) for r in days.collect()}
    assert got["2020-01-03"] == (1.0, "2019-11-01")
    diff = features.transform_levels(features.ref_level(days), {"a": meta(transform="diff")})
    assert {str(r["ref_period"]): r["feature"] for r in diff.collect()} == {"2019-10-01": None, "2019-11-01": 0.0, "2019-12-01": 2.0}


def test_age_news_and_same_day_events(spark):
    c = cal(spark, ("a", "2019-11-01", None, 1.0, "2020-01-02"), ("a", "2019-12-01", None, 2.0, "2020-01-05"), ("a", "2019-10-01", None, 9.0, "2020-01-05"), ("b", "2019-10-01", None, 9.0, "2021-01-05"))
    rows = panel.daily_panel(c, "2020-01-01", "2020-01-06").orderBy("series", "as_of_date").collect()
    a = [r for r in rows if r["series"] == "a"]
    assert [r["age_days"] for r in a] == [None, 0, 1, 2, 0, 1]
    assert [r["is_new_release"] for r in a] == [0, 1, 0, 0, 1, 0]
    assert a[-1]["value"] == 2.0
    assert len(rows) == 12 and rows[-1]["value"] is None  # a series without events inside has empty days
    assert panel.headline_events(c).count() == 3
    assert panel.daily_panel(c.limit(0), "2020-01-01", "2020-01-06").count() == 0


def test_no_value_before_it_is_available(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in "xyz":
        for k in range(30):
            at = date(2020, 1, 1) + timedelta(days=int(rng.integers(0, 90)))
            rows.append((s, str(at - timedelta(days=int(rng.integers(5, 60)))), None, float(k), str(at)))
    c = cal(spark, *rows)
    days = panel.daily_panel(c, "2020-01-01", "2020-03-31").collect()
    assert len(days) == 3 * 91
    for r in days:
        seen = [x for x in rows if x[0] == r["series"] and d(x[4]) <= r["as_of_date"]]
        if not seen:
            assert r["value"] is None and r["age_days"] is None and not r["is_new_release"]
            continue
        last = max(d(x[4]) for x in seen)
        best = max((x for x in seen if d(x[4]) == last), key=lambda x: x[1])
        assert str(r["ref_period"]) == best[1] and r["age_days"] == (r["as_of_date"] - last).days and r["is_new_release"] == (r["age_days"] == 0)


def test_dates(spark):
    got = one(spark, *[dates.sticky_target(F.lit(x).cast("date"), 27).alias(x) for x in ("2020-04-26", "2020-04-27", "2020-04-28")])
    assert [str(v) for v in got] == ["2020-01-01", "2020-01-01", "2020-04-01"]
    assert [str(one(spark, dates.period_end(F.lit("2020-02-10").cast("date"), F.lit(f)).alias("x"))["x"]) for f in "QmWD"] == ["2020-03-31", "2020-02-29", "2020-02-10", "2020-02-10"]
    with pytest.raises(Exception, match="unknown frequency"):
        one(spark, dates.period_end(F.lit("2020-02-10").cast("date"), F.lit("A")))
    assert str(one(spark, dates.release_date(F.lit("2020-02-10").cast("date"), F.lit("A"), F.lit(3)).alias("x"))["x"]) == "2020-02-13"
    assert str(one(spark, F.add_months(F.lit("2020-02-29").cast("date"), -180).alias("x"))["x"]) == "2005-02-28"
    assert spark.range(1).select(dates.day_spine(F.lit("2020-01-02").cast("date"), F.lit("2020-01-01").cast("date"))).count() == 0


def test_labels(spark):
    def trainer(n):
        return one(spark, labels.trainer_bucket(F.date_add(F.lit("2020-01-01").cast("date"), F.lit(n).cast("int")), F.lit("2020-01-01").cast("date")).alias("x"))["x"]

    assert [trainer(n) for n in (61, 60, 21, 20, -3, None)] == ["early", "mid", "mid", "late", "late", "unknown"]
    assert [one(spark, labels.bucket(F.lit(n)).alias("x"))["x"] for n in (60, 59, 30, 29, 10, 9, 0, -1)] == ["early", "mid", "mid", "late", "late", "final", "final", "unknown"]
    assert [one(spark, labels.trainer_time_slice(F.lit(x).cast("date")).alias("x"))["x"] for x in ("2005-06-01", "2012-01-01")] == ["2023_plus", "2010_2014"]


def test_transforms(spark):
    levels = spark.createDataFrame([(s, date(2020, m, 1), v) for s, vs in {"a": (100.0, 110.0, 99.0), "z": (0.0, 5.0)}.items() for m, v in enumerate(vs, 1)], "series string, ref_period date, value double")

    def run(t, s):
        return [r["feature"] for r in features.transform_levels(levels, {"a": meta(transform=t), "z": meta(transform=t)}).where(F.col("series") == s).orderBy("ref_period").collect()]

    assert run("mom", "a") == [None, pytest.approx(0.1), pytest.approx(-0.1)]
    assert run("diff", "a") == [None, 10.0, -11.0]
    assert run("mom", "z") == [None, None] and run("log_diff", "z") == [None, None]
    assert run("", "a") == run("level", "a") == [100.0, 110.0, 99.0]
    with pytest.raises(ValueError):
        features.transformed(F.col("value"), "cube")


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, 1.0), (0.0, 0.0), (None, 5.0)], "y double, y_hat double")
    r = df.agg(*metrics()).first()
    assert (r["n_obs"], r["rmse"], r["mae"], r["bias"], r["hit_rate"]) == (3, pytest.approx(math.sqrt(5 / 3)), 1.0, 1.0, pytest.approx(2 / 3))
    empty = df.limit(0).agg(*metrics()).first()
    assert empty["n_obs"] == 0 and empty["rmse"] is None


def test_autoregression(spark):
    m = autoregression.ARModel().fit([1, 2, 3, 4])
    assert m.coefficients == pytest.approx([1, 1]) and m.predict_next([1, 2, 3, 4]) == pytest.approx(5)
    with pytest.raises(ValueError):
        autoregression.ARModel(2).fit([1, 2])
    with pytest.raises(RuntimeError):
        autoregression.ARModel().predict_next([1])
    q = spark.createDataFrame([("AR", d("2020-01-01"), d("2020-04-27"), 1.0, 1.1, None, None)], "model_name string, target_ref_period date, target_release_date date, y double, y_hat double, train_start date, train_end date")
    days = autoregression.expand_to_daily(q).agg(F.count("*"), F.max("distance_to_release"), F.min("distance_to_release")).first()
    assert tuple(days) == (91, 117, 27)
    assert autoregression.expand_to_daily(q, "2021-01-01").count() == 0


@pytest.mark.parametrize("p", [1, 2, 3])
def test_rolling_autoregression_against_numpy(spark, p):
    rng = np.random.default_rng(p)
    y = np.cumsum(rng.normal(size=60)) * 0.3 + rng.normal(size=60)
    quarters = [date(2000 + k // 4, 3 * (k % 4) + 1, 1) for k in range(60)]
    release = [q + timedelta(days=118) for q in quarters]
    targets = spark.createDataFrame(list(zip(quarters, release, map(float, y), strict=True)), "ref_period date, release_date date, y double")
    cfg = ARConfig(p=p, window_years=5, min_train_quarters=10, test_start="2008-01-01")
    got = {r["target_ref_period"]: r["y_hat"] for r in autoregression.quarterly_forecasts(targets, cfg).collect()}
    assert len(got) == 28
    for t in quarters[32:]:
        own = [v for q, r, v in zip(quarters, release, y, strict=True) if r < t and q >= t.replace(year=t.year - 5)]
        assert got[t] == pytest.approx(autoregression.ARModel(p).fit(own).predict_next(own), abs=1e-8)


def _series(n=1500, k=3, seed=0, start=date(2000, 1, 1)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * [1, 50, 0.01][:k] + [0, 200, 0.05][:k]
    y = x @ np.array([1.0, -0.02, 40.0][:k]) + rng.normal(size=n)
    rows = []
    for i in range(n):
        missing = rng.random() < 0.05
        rows.append((start + timedelta(days=i), None if rng.random() < 0.03 else float(y[i]), date(2000, 1, 1) + timedelta(days=i + int(rng.integers(0, 90))), *[None if missing and j == 0 else float(v) for j, v in enumerate(x[i])]))
    return rows


SCHEMA = "origin_date date, y double, model_target_release_date date, x_a double, x_b double, x_c double"


@pytest.mark.parametrize("start", ["2002-01-01", "2002-01-15"])
def test_rolling_regression_against_numpy(spark, start):
    rows, xs = _series(), ["x_a", "x_b", "x_c"]
    ds = spark.createDataFrame(rows, SCHEMA)
    cfg = RollingConfig(test_start=start, window_years=1)
    coefs = {r["refit_date"]: r for r in rolling.coefficients(ds, xs, cfg).collect()}
    assert min(coefs) == d(start) and len(coefs) == 26
    for refit, r in coefs.items():
        own = [row for row in rows if refit.replace(year=refit.year - 1) <= row[0] < refit and row[1] is not None]
        assert r["n_rows"] == len(own)
        b = linalg.least_norm(np.array([[np.nan if v is None else v for v in row[3:]] for row in own]), np.array([row[1] for row in own]))
        assert [r[f"b_{i}"] for i in range(4)] == pytest.approx(b.tolist(), rel=1e-7, abs=1e-7)
    preds = rolling.run_rolling(ds, cfg, xs)
    assert preds.count() == preds.select("origin_date").distinct().count() == sum(row[0] >= d(start) for row in rows)
    assert preds.where("y_hat is null and x_a is not null or y_hat is not null and (nowcast_sigma is null or ci_low_95 > ci_high_95)").count() == 0


def test_collinear_and_constant_features(spark):
    rows = [(*r[:3], r[3], None if r[3] is None else 2 * r[3], 1.0) for r in _series()]
    ds = spark.createDataFrame(rows, SCHEMA)
    cfg = RollingConfig(test_start="2002-01-01", window_years=1)
    both = rolling.coefficients(ds, ["x_a", "x_b"], cfg).collect()
    single = {r["refit_date"]: r for r in rolling.coefficients(ds, ["x_a"], cfg).collect()}
    for r in both:  # least norm on standardised features shares the weight equally
        assert r["b_1"] == pytest.approx(single[r["refit_date"]]["b_1"] / 2, abs=1e-8) and r["b_2"] == pytest.approx(r["b_1"] / 2, abs=1e-8)
    assert all(r["b_1"] is None for r in rolling.coefficients(ds, ["x_a", "x_c"], cfg).collect())
    assert rolling.run_rolling(ds, cfg, ["x_a", "x_c"]).count() == 0
    reasons = {r["reason"] for r in rolling.eligibility(ds, ["x_a", "x_c"], cfg).collect()}
    assert reasons == {"a feature does not vary"}
    with pytest.raises(ValueError):
        rolling.run_rolling(ds.select("origin_date", "y"), cfg)


def test_single_models(spark):
    df = spark.createDataFrame([(1.0, 1.0, "early"), (2.0, 3.0, "early"), (3.0, 5.0, "late"), (None, 4.0, "late")], "x double, y double, distance_bucket string")
    m = rolling.LinearModel().fit(df, ["x"])
    assert m.coefficients == pytest.approx([-1, 2])
    assert [r["y_hat"] for r in m.predict(df).collect()] == [pytest.approx(1), pytest.approx(3), pytest.approx(5), None]
    with pytest.raises(ValueError):
        rolling.LinearModel().fit(df.where("x is null"), ["x"])
    with pytest.raises(RuntimeError):
        rolling.LinearModel().predict(df)
    staged = rolling.StageModel(min_stage_rows=2).fit(df, ["x"])
    assert set(staged.by_stage) == {"early"} and staged.predict(df).count() == 4


@pytest.mark.parametrize("case", ["plain", "collinear", "constant", "both", "one row", "large"])
def test_least_norm_of_moments(spark, case):
    """Against least squares over the rows themselves, whose solution is of least norm, too."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) + [1, 2, 3]
    if case in ("collinear", "both"):
        x[:, 1] = 2 * x[:, 0] - 1
    if case in ("constant", "both"):
        x[:, 2] = 5.0
    if case == "large":
        x = np.column_stack([x[:, 0] * 1e6, x[:, 0] * 2e6, x[:, 2] * 1e5])
    if case == "one row":
        x = x[:1]
    y = x @ [0.5, 0.25, -1] + rng.normal(size=len(x)) + 4
    names = ["x_a", "x_b", "x_c"]
    df = spark.createDataFrame([(*map(float, row), float(v), "early") for row, v in zip(x, y, strict=True)], "x_a double, x_b double, x_c double, y double, distance_bucket string")
    for design, constant in ((np.column_stack([np.ones(len(x)), x]), True), (x, False)):
        want = np.linalg.lstsq(design, y, rcond=1e-9)[0]
        got = linalg.least_norm_of_moments(df.agg(*linalg.moments(names, "y")).first().asDict(), 3, constant)
        assert design @ (got if constant else got[1:]) == pytest.approx(design @ want, rel=1e-6, abs=1e-6)
        assert (got if constant else got[1:]) == pytest.approx(want, rel=1e-5, abs=1e-7)
    model = rolling.LinearModel().fit(df, names)
    staged = rolling.StageModel(min_stage_rows=1).fit(df, names)
    assert staged.by_stage["early"].coefficients == pytest.approx(model.coefficients)


def test_autoregression_on_a_flat_history(spark):
    quarters = [(d(f"{2000 + k // 4}-{3 * (k % 4) + 1:02d}-01"), d(f"{2000 + k // 4}-{3 * (k % 4) + 2:02d}-20"), 2.0) for k in range(24)]
    targets = spark.createDataFrame(quarters, "ref_period date, release_date date, y double")
    for p, constant in ((1, True), (2, True), (1, False)):
        cfg = ARConfig(p=p, window_years=4, min_train_quarters=8, test_start="2004-01-01", constant=constant, true_horizon=True)
        rows = autoregression.quarterly_forecasts(targets, cfg).collect()
        assert rows and all(r["y_hat"] == pytest.approx(2.0) for r in rows)
        fit = autoregression.ar_fits(targets, cfg).first()
        model = autoregression.ARModel(p, constant).fit([2.0] * fit["n_train"])
        assert [fit[f"b_{i}"] for i in range(0 if constant else 1, p + 1)] == pytest.approx(model.coefficients.tolist())


def test_horizon_of_many_steps(spark):
    """The last release lies three years back: the forecast is carried on over all quarters since."""
    rng = np.random.default_rng(4)
    y = [1.0]
    for _ in range(39):
        y.append(0.3 + 0.8 * y[-1] + 0.1 * rng.normal())
    quarters = [(d(f"{1990 + k // 4}-{3 * (k % 4) + 1:02d}-01"), d("1999-06-01") if k < 40 else d("2010-01-01"), v) for k, v in enumerate([*y, *[0.0] * 14])]
    targets = spark.createDataFrame(quarters, "ref_period date, release_date date, y double")
    for p in (1, 2):
        cfg = ARConfig(p=p, window_years=20, min_train_quarters=10, test_start="2003-01-01", true_horizon=True)
        got = {str(r["target_ref_period"]): r["y_hat"] for r in autoregression.quarterly_forecasts(targets, cfg).collect()}
        model, path = autoregression.ARModel(p).fit(y), list(y)
        for _ in range(13):
            path.append(model.predict_next(path))
        assert got["2003-01-01"] == pytest.approx(path[-1], abs=1e-8)


def test_refit_schedule_starts_in_mid_month(spark):
    ds = spark.createDataFrame([(d("1990-04-02"),)], "origin_date date")
    got = rolling.refit_schedule(ds, RollingConfig(test_start="1990-01-15")).orderBy("refit_date").collect()
    assert [str(r["refit_date"]) for r in got] == ["1990-01-15", "1990-02-01", "1990-03-01", "1990-04-01"]
    assert str(got[-1]["next_refit"]) == "1990-04-03"


def test_configuration(tmp_path):
    with pytest.raises(KeyError):
        parse_series_meta({"a": {"vendor": "v"}})
    with pytest.raises(FileNotFoundError):
        load_series_meta(tmp_path / "none.yaml")
    m = parse_series_meta({"a": {"vendor": "v", "code": "C", "freq": "Q", "release_rule": "r", "release_lag_days": "3"}})["a"]
    assert (m.name, m.transform, m.revision_type, m.vintage_source, m.vintage_mode, m.missing_policy, m.release_lag_days) == ("a", "", "single", "final", "latest", "skip", 3)
    assert not m.problems() and len(meta(freq="X", transform="y", release_lag_days=-1).problems()) == 3


def test_unknown_series(spark):
    raw = spark.createDataFrame([("zz", d("2020-01-01"), None, 1.0)], "series string, ref_period date, vintage_date date, value double")
    with pytest.raises(Exception, match="without configuration"):
        build_calendar(raw, {"g": meta()}).collect()
    assert [r["series"] for r in unknown_series(raw, {"g": meta()}).collect()] == ["zz"]
    with pytest.raises(ValueError):
        add_calendar(raw.drop("ref_period"), meta())
    assert not integrity(raw, {"g": meta()}).first()["ok"]
    with pytest.raises(KeyError):
        dataset.bridge_dataset(panel.daily_panel(cal(spark), "2020-01-01", "2020-01-02"), {"g": meta()}, "h")


def test_comparison(spark):
    df = spark.createDataFrame([("x", "7", "0.5")], "bucket string, n string, rmse string")
    long = evaluation.to_long(df, "distance_bucket", "distance_bucket")
    assert tuple(long.first()) == ("UNKNOWN", "distance_bucket", "x", 7, 0.5, None, None, None)
    assert evaluation.to_long(df, "any", None, "M").first()["slice"] == "overall"
    with pytest.raises(ValueError):
        evaluation.to_long(df.drop("bucket"), "distance_bucket", "distance_bucket")
    with pytest.raises(RuntimeError):
        evaluation.compare([])


def test_signals(spark):
    rows = [(d("2020-01-01"), d("2020-01-01"), p, 1.0) for p in (3.5, -1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "origin_date date, target_quarter date, point double, std double")
    got = signals.to_signals(df).collect()
    assert [r["signal"] for r in got] == [1, -1, 0, None]
    assert got[0]["confidence"] == pytest.approx(1 - math.exp(-1)) and got[3]["confidence"] is None
