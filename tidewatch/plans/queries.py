"""The named queries: every operator applied to the demo economy, the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import ARConfig, EvaluationConfig, RollingConfig, meta_frame
from tidewatch.functions import dates, labels
from tidewatch.functions.metrics import METRICS
from tidewatch.operators import autoregression, bitemporal, calendar, checks, dataset, evaluation, features, panel, quantiles, rolling, signals
from tidewatch.plans.daily_state import DailyState
from tidewatch.plans.engine import Nowcaster
from tidewatch.session import checkpoint_dir, cut, table
from tidewatch.sources import fixtures, observations

Query = Callable[[SparkSession, str], DataFrame]

START, END, TARGET = fixtures.PANEL_START, fixtures.PANEL_END, fixtures.TARGET
LAG = 27
XS = ["x_order_value", "x_order_count", "x_ship_quantity", "x_discount_level", "x_urgent_orders"]
ROLLING = RollingConfig(test_start="1998-01-01", window_years=3)
MID_MONTH = replace(ROLLING, test_start="1998-01-15")
AR = ARConfig(window_years=3, min_train_quarters=8, test_start="1998-01-01")
SLICES = EvaluationConfig(time_slices=(("1998", "1998-01-01", "1998-12-31"), ("1999", "1999-01-01", "1999-12-31"), ("2000_plus", "2000-01-01", None)))

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def nowcaster(spark: SparkSession, sf_dir: str, **kw) -> Nowcaster:
    return Nowcaster(fixtures.demo_raw(spark, sf_dir), fixtures.demo_meta(), TARGET, START, END, ROLLING, AR, **kw)


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nowcaster(spark, sf_dir).calendar()


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nowcaster(spark, sf_dir).panel()


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset is small (a row a day) and several operators read it more than once, so it is computed once."""
    return cut(nowcaster(spark, sf_dir).dataset())


def _rounded(df: DataFrame, places: int = 6, *skip: str) -> DataFrame:
    """Derived doubles rounded, so that two engines' sums compare; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


# -- configuration and scans --------------------------------------------------------------------------


@query
def series_meta(spark, sf_dir):
    return meta_frame(spark, fixtures.demo_meta())


def _exported(spark: SparkSession, sf_dir: str) -> str:
    """The raw series as CSV files, one for each series, in a new folder."""
    raw, path = cut(fixtures.demo_raw(spark, sf_dir)), f"{checkpoint_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    for name, meta in fixtures.demo_meta().items():
        columns = observations.VINTAGE_COLUMNS if observations.has_vintages(meta) else observations.FINAL_COLUMNS
        raw.where(F.col("series") == name).select(*columns).write.option("header", True).csv(f"{path}/{observations.file_name(meta)}")
    return path


@query
def raw_vintage_scan(spark, sf_dir):
    return observations.load_raw_series(spark, "order_value", fixtures.demo_meta()["order_value"], _exported(spark, sf_dir))


@query
def raw_final_scan(spark, sf_dir):
    return observations.load_raw_series(spark, "urgent_orders", fixtures.demo_meta()["urgent_orders"], _exported(spark, sf_dir))


@query
def raw_union_all(spark, sf_dir):
    return observations.load_all_raw_series(spark, fixtures.demo_meta(), _exported(spark, sf_dir))


@query
def series_filter(spark, sf_dir):
    return observations.select_series(fixtures.demo_raw(spark, sf_dir), ["order_value", "urgent_orders"])


# -- dates --------------------------------------------------------------------------------------------


def _order_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()


def _freqs(spark, sf_dir):
    return _order_days(spark, sf_dir).withColumn("freq", F.explode(F.array(*map(F.lit, "QMWD"))))


@query
def period_end_all_freqs(spark, sf_dir):
    return _freqs(spark, sf_dir).select("d", "freq", dates.period_end(F.col("d"), F.col("freq")).alias("period_end"))


@query
def release_date_calc(spark, sf_dir):
    return _freqs(spark, sf_dir).select("d", "freq", dates.release_date(F.col("d"), F.col("freq"), F.lit(LAG)).alias("release_date"))


@query
def available_date_strict(spark, sf_dir):
    cal = nowcaster(spark, sf_dir, strict=True).calendar()
    return cal.select("series", "ref_period", "vintage_date", "release_date", "available_date")


@query
def calendar_one_series(spark, sf_dir):
    raw = observations.select_series(fixtures.demo_raw(spark, sf_dir), ["order_value"])
    return calendar.add_calendar(raw, fixtures.demo_meta()["order_value"])


@query
def calendar_all_series(spark, sf_dir):
    return _calendar(spark, sf_dir)


@query
def quarter_bounds(spark, sf_dir):
    q = dates.quarter_start(F.col("d"))
    return _order_days(spark, sf_dir).select("d", q.alias("q_start"), dates.quarter_end(q).alias("q_end"), dates.shift_quarter(q, -1).alias("q_before"), dates.shift_quarter(q, 2).alias("q_after_next"))


@query
def sticky_target_quarter(spark, sf_dir):
    return _order_days(spark, sf_dir).select("d", dates.sticky_target(F.col("d"), LAG).alias("model_target"))


@query
def target_release_proxy(spark, sf_dir):
    q = F.when(F.day("d") > 3, dates.quarter_start(F.col("d")))
    return _order_days(spark, sf_dir).select("d", dates.quarter_release(q, LAG).alias("release"))


@query
def date_spine(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    return ends.select(dates.day_spine(F.col("lo"), F.col("hi")).alias("d"))


@query
def panel_range(spark, sf_dir):
    return panel.panel_range(_panel(spark, sf_dir))


# -- panels -------------------------------------------------------------------------------------------


@query
def headline_events(spark, sf_dir):
    return panel.headline_events(_calendar(spark, sf_dir))


@query
def daily_asof_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


@query
def panel_is_new(spark, sf_dir):
    return _panel(spark, sf_dir).where("is_new_release = 1").groupBy("series").agg(F.count(F.lit(1)).alias("releases"), F.min("as_of_date").alias("first_release"), F.max("as_of_date").alias("last_release"))


@query
def panel_age_days(spark, sf_dir):
    return _panel(spark, sf_dir).groupBy("series").agg(F.max("age_days").alias("oldest"), F.sum("age_days").alias("total_age"), F.count("age_days").alias("days_seen"), F.count(F.lit(1)).alias("days"))


@query
def series_panel(spark, sf_dir):
    cal = _calendar(spark, sf_dir).where("series = 'order_value'")
    return panel.daily_panel(cal, START, END)


def _wide(measure: str) -> Query:
    return lambda spark, sf_dir: panel.wide_panel(_panel(spark, sf_dir), measure, list(fixtures.demo_meta()))


QUERIES |= {"panel_value_wide": _wide("value"), "panel_ref_wide": _wide("ref_period"), "panel_age_wide": _wide("age_days"), "panel_new_wide": _wide("is_new_release")}


@query
def panel_from_raw(spark, sf_dir):
    """Files to panel: scan, calendar, events, as-of days."""
    return panel.panels_from_raw(spark, fixtures.demo_meta(), _exported(spark, sf_dir), START, END)


@query
def panel_carry_in(spark, sf_dir):
    return panel.daily_panel(_calendar(spark, sf_dir), "1997-03-05", "1997-12-31", carry_in=True)


@query
def panel_as_of(spark, sf_dir):
    return nowcaster(spark, sf_dir).panel(as_of="1999-06-30")


AS_OFS = ["1996-01-15", "1997-02-14", "1998-07-31", "1999-06-30", "2000-12-24", "2002-03-01"]


@query
def panels_as_of(spark, sf_dir):
    """The panels of six dates in one plan, none with a vintage dated after its own."""
    return bitemporal.panels_as_of(_calendar(spark, sf_dir), AS_OFS, START, END)


@query
def real_time_features(spark, sf_dir):
    """Every day's features as they were known on that day."""
    return _rounded(bitemporal.knowledge_features(_calendar(spark, sf_dir), fixtures.demo_meta(), START, END).drop("age_days"))


@query
def datasets_as_of(spark, sf_dir):
    return _rounded(nowcaster(spark, sf_dir).datasets_as_of(AS_OFS[1:4]))


@query
def panel_vintage_modes(spark, sf_dir):
    """Four series, each by its own vintage mode; all releases are seen from their own dates on."""
    modes = {"revenue_growth": "first_release", "order_value": "all_releases", "order_count": "latest", "ship_quantity": "reference"}
    metas = {k: replace(m, vintage_mode=modes.get(k, "reference")) for k, m in fixtures.demo_meta().items()}
    return panel.daily_panel(panel.by_vintage_mode(_calendar(spark, sf_dir), metas), START, END)


@query
def panel_strict(spark, sf_dir):
    return nowcaster(spark, sf_dir, strict=True).panel()


@query
def panel_jagged_edge(spark, sf_dir):
    return panel.vintage_panel(_calendar(spark, sf_dir), START, END)


@query
def panel_first_release(spark, sf_dir):
    return panel.daily_panel(panel.pick_vintages(_calendar(spark, sf_dir), "first_release"), START, END)


@query
def panel_missing_policy(spark, sf_dir):
    metas = {k: replace(m, missing_policy=p) for (k, m), p in zip(fixtures.demo_meta().items(), ("skip", "carry_forward", "zero", "flag_only", "skip", "zero"), strict=True)}
    return panel.apply_missing_policy(_panel(spark, sf_dir), metas, stale_days=20)


@query
def panel_derived_features(spark, sf_dir):
    return _rounded(panel.derived_features(_panel(spark, sf_dir)).select("series", "as_of_date", "missing", "freshness", "news"))


@query
def event_type_panel(spark, sf_dir):
    """Daily series of another table: the sum of values of each event type, available a day later."""
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("ref_period")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    cal = daily.select("series", "ref_period", F.lit(None).cast("date").alias("vintage_date"), "value", F.date_add("ref_period", 1).alias("available_date"))
    return panel.daily_panel(cal, "2024-01-01", "2024-02-15")


# -- features and dataset -------------------------------------------------------------------------------


@query
def ref_level_compress(spark, sf_dir):
    return features.ref_level(_panel(spark, sf_dir))


def _feature(series: str) -> Query:
    def run(spark, sf_dir):
        levels = features.ref_level(_panel(spark, sf_dir).where(F.col("series") == series))
        return _rounded(features.transform_levels(levels, fixtures.demo_meta()).select("ref_period", "feature"))

    return run


QUERIES |= {"feat_level": _feature("discount_level"), "feat_diff": _feature("order_count"), "feat_mom": _feature("order_value"), "feat_log_diff": _feature("urgent_orders")}


@query
def feat_map_back(spark, sf_dir):
    days = _panel(spark, sf_dir).where("series = 'order_count'")
    found = features.transform_levels(features.ref_level(days), fixtures.demo_meta())
    return _rounded(features.map_back(days, found).select("as_of_date", "ref_period", "feature"))


@query
def features_daily(spark, sf_dir):
    return _rounded(features.features_daily(_panel(spark, sf_dir), fixtures.demo_meta()))


@query
def bridge_dataset(spark, sf_dir):
    return _rounded(nowcaster(spark, sf_dir).dataset())


@query
def bridge_dataset_filtered(spark, sf_dir):
    ds = nowcaster(spark, sf_dir).dataset(features=["order_value", "order_count", "discount_level"], exclude=["order_count"], min_features=2, before_release=True)
    return _rounded(ds)


@query
def bridge_dataset_model_target(spark, sf_dir):
    """y is the model target's own first release, the target always the running quarter."""
    n = nowcaster(spark, sf_dir)
    return _rounded(n.dataset(features=["order_value"], label_mode="model_target", target_mode="calendar", targets=n.targets()))


@query
def feature_nonnull_ratio(spark, sf_dir):
    return _rounded(dataset.non_null_ratio(nowcaster(spark, sf_dir).dataset()))


# -- walk-forward training ------------------------------------------------------------------------------


@query
def refit_schedule(spark, sf_dir):
    return rolling.refit_schedule(_dataset(spark, sf_dir), MID_MONTH)


@query
def train_window_stats(spark, sf_dir):
    stats = rolling.window_moments(_dataset(spark, sf_dir), ["x_order_value"], MID_MONTH)
    return _rounded(stats.select("refit_date", "n_rows", "n", F.col("s_0").alias("sum_x"), F.col("s_1").alias("sum_y"), F.col("s_0_1").alias("sum_xy")))


@query
def eligible_refits(spark, sf_dir):
    return rolling.eligibility(_dataset(spark, sf_dir), XS, replace(ROLLING, test_start="1995-03-10"))


@query
def zscore_params(spark, sf_dir):
    return _rounded(rolling.zscore_params(_dataset(spark, sf_dir), ["x_order_value", "x_discount_level"], MID_MONTH))


@query
def zscore_apply(spark, sf_dir):
    ds, xs = _dataset(spark, sf_dir), ["x_order_value", "x_discount_level"]
    return _rounded(rolling.zscore_apply(ds, rolling.zscore_params(ds, xs, ROLLING), xs, ROLLING), 5)


def _ols(xs: list[str], cfg: RollingConfig, places: int) -> Query:
    return lambda spark, sf_dir: _rounded(rolling.coefficients(_dataset(spark, sf_dir), xs, cfg), places)


QUERIES |= {"ols_single_feature": _ols(XS[:1], MID_MONTH, 5), "ols_two_feature": _ols(XS[:2], ROLLING, 5), "ols_full": _ols(XS, ROLLING, 4)}


@query
def oos_assignment(spark, sf_dir):
    return rolling.out_of_sample(_dataset(spark, sf_dir), MID_MONTH).select("origin_date", "refit_date")


@query
def distance_bucket_trainer(spark, sf_dir):
    return _dataset(spark, sf_dir).select("origin_date", labels.trainer_bucket(F.col("model_target_release_date"), F.col("origin_date")).alias("distance_bucket"))


@query
def stage_sigmas(spark, sf_dir):
    return _rounded(rolling.stage_sigmas(_dataset(spark, sf_dir), XS[:1], ROLLING).select("refit_date", "distance_bucket", F.col("overall").cast("int").alias("overall"), "sigma"))


def _predictions(spark, sf_dir, xs):
    return rolling.run_rolling(_dataset(spark, sf_dir), ROLLING, xs)


@query
def oos_sigma(spark, sf_dir):
    return _rounded(_predictions(spark, sf_dir, XS[:1]).select("origin_date", "distance_bucket", "nowcast_sigma"))


@query
def oos_ci(spark, sf_dir):
    return _rounded(_predictions(spark, sf_dir, XS[:1]).select("origin_date", "y_hat", "ci_low_95", "ci_high_95"), 5)


@query
def bridge_oos_predictions(spark, sf_dir):
    preds = _predictions(spark, sf_dir, XS)
    return _rounded(preds.select("origin_date", "model_target_ref_period", "model_target_release_date", "y", "y_hat", "model_name", "distance_bucket", "nowcast_sigma", "ci_low_95", "ci_high_95"), 4)


@query
def nowcast_clean(spark, sf_dir):
    return _rounded(rolling.clean_nowcast(_predictions(spark, sf_dir, XS[:1])), 5)


@query
def stage_ols_coeffs(spark, sf_dir):
    return _rounded(rolling.stage_coefficients(_dataset(spark, sf_dir), XS[:1], ROLLING), 5)


@query
def stage_ols_predict(spark, sf_dir):
    ds = _dataset(spark, sf_dir)
    return _rounded(rolling.stage_predict(ds, XS[:1], ROLLING).select("origin_date", "distance_bucket", "stage_model", "y_hat"), 5)


# -- autoregression -------------------------------------------------------------------------------------


@query
def quarterly_targets(spark, sf_dir):
    return nowcaster(spark, sf_dir).targets()


@query
def ar1_coeffs(spark, sf_dir):
    fits = autoregression.ar_fits(cut(nowcaster(spark, sf_dir).targets()), AR)
    return _rounded(fits.select("t_eval", "n_train", "train_start", "train_end", F.col("b_0").alias("c"), F.col("b_1").alias("phi")))


@query
def ar1_quarterly(spark, sf_dir):
    return _rounded(autoregression.quarterly_forecasts(cut(nowcaster(spark, sf_dir).targets()), AR))


@query
def ar2_quarterly(spark, sf_dir):
    cfg = replace(AR, p=2, model_name="AR_p2")
    return _rounded(autoregression.quarterly_forecasts(cut(nowcaster(spark, sf_dir).targets()), cfg), 5)


@query
def ar1_true_horizon(spark, sf_dir):
    return _rounded(autoregression.quarterly_forecasts(cut(nowcaster(spark, sf_dir).targets()), replace(AR, true_horizon=True)))


@query
def ar1_by_nation(spark, sf_dir):
    """The growth of every nation's orders, 25 targets in one plan."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "QUARTER").alias("ref_period"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    met = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    quarterly = met.groupBy("c_nationkey", "ref_period").agg(F.sum("p").cast("double").alias("s"))
    growth = 100 * (F.col("s") / F.lag("s").over(Window.partitionBy("c_nationkey").orderBy("ref_period")) - 1)
    release = F.date_add(dates.quarter_end(F.col("ref_period")), LAG)
    targets = quarterly.select("c_nationkey", "ref_period", release.alias("release_date"), growth.alias("y")).where("y is not null")
    return _rounded(autoregression.quarterly_forecasts(targets, AR, keys=["c_nationkey"]), 4)


def _ar_daily(spark, sf_dir):
    return autoregression.expand_to_daily(autoregression.quarterly_forecasts(cut(nowcaster(spark, sf_dir).targets()), AR))


@query
def ar1_daily(spark, sf_dir):
    return _rounded(_ar_daily(spark, sf_dir))


# -- evaluation -----------------------------------------------------------------------------------------


@query
def metrics_overall(spark, sf_dir):
    return _rounded(evaluation.metrics_by(_ar_daily(spark, sf_dir), []))


@query
def metrics_by_model(spark, sf_dir):
    return _rounded(evaluation.metrics_by(_ar_daily(spark, sf_dir), ["model_name"], r2=True))


@query
def metrics_by_distance(spark, sf_dir):
    return _rounded(evaluation.metrics_by_distance(_ar_daily(spark, sf_dir)))


@query
def metrics_by_time_slice(spark, sf_dir):
    return _rounded(evaluation.metrics_by_time_slice(_ar_daily(spark, sf_dir), SLICES))


@query
def distance_bucket_eval(spark, sf_dir):
    days = F.explode(F.sequence(F.lit(-5), F.lit(130)))
    return spark.range(1).select(days.alias("d")).select("d", labels.bucket(F.col("d")).alias("distance_bucket"))


@query
def time_slice_label(spark, sf_dir):
    days = dates.day_spine(F.lit("2005-06-01").cast("date"), F.lit("2024-06-01").cast("date"))
    return spark.range(1).select(days.alias("d")).select("d", labels.trainer_time_slice(F.col("d")).alias("time_slice"))


@query
def stage_sigmas_full(spark, sf_dir):
    """Residual spreads of the model over all features."""
    return _rounded(rolling.stage_sigmas(_dataset(spark, sf_dir), XS, ROLLING).select("refit_date", "distance_bucket", F.col("overall").cast("int").alias("overall"), "sigma"), 4)


@query
def stage_ols_full(spark, sf_dir):
    """The stage-aware model over all features, from a packed dataset."""
    ds = cut(nowcaster(spark, sf_dir).dataset(packed=True))
    return _rounded(rolling.stage_predict(ds, dataset.PACKED, ROLLING).select("origin_date", "distance_bucket", "stage_model", "y_hat"), 4)


@query
def bridge_metrics_sets(spark, sf_dir):
    return _rounded(evaluation.slice_metrics(_predictions(spark, sf_dir, XS[:1])), 5)


def _ar_tables(spark, sf_dir):
    ar = cut(_ar_daily(spark, sf_dir))
    return {"overall": evaluation.metrics_by(ar, ["model_name"]), "distance_bucket": evaluation.metrics_by_distance(ar), "time_slice": evaluation.metrics_by_time_slice(ar, SLICES)}


@query
def cmp_standardize(spark, sf_dir):
    df = _ar_tables(spark, sf_dir)["overall"].select(F.col("n_obs").alias("obs"), "rmse")
    return _rounded(evaluation.standardise(df).select("model_name", *METRICS))


@query
def model_compare(spark, sf_dir):
    found = [evaluation.to_long(t, kind, None if kind == "overall" else kind, "AR_p1_15y") for kind, t in _ar_tables(spark, sf_dir).items()]
    ds = _dataset(spark, sf_dir)
    simple = rolling.run_rolling(ds, ROLLING, XS[:1])
    stage = rolling.stage_predict(ds, XS[:1], ROLLING)
    return _rounded(evaluation.compare([*found, evaluation.slice_metrics(simple), evaluation.slice_metrics(stage)]), 5)


# -- diagnostics ----------------------------------------------------------------------------------------


@query
def available_range(spark, sf_dir):
    return checks.available_range(_calendar(spark, sf_dir))


@query
def samples_per_quarter(spark, sf_dir):
    return checks.samples_per_quarter(nowcaster(spark, sf_dir).dataset())


@query
def quarter_thirds_density(spark, sf_dir):
    return _rounded(checks.quarter_thirds(nowcaster(spark, sf_dir).dataset()))


@query
def date_slice_10d(spark, sf_dir):
    return _rounded(checks.date_slice(nowcaster(spark, sf_dir).dataset(), "2000-03-01"))


@query
def feature_coverage_decade(spark, sf_dir):
    return _rounded(checks.decade_coverage(nowcaster(spark, sf_dir).dataset()))


@query
def calendar_violations(spark, sf_dir):
    return checks.calendar_violations(_calendar(spark, sf_dir))


@query
def raw_profile(spark, sf_dir):
    return _rounded(checks.raw_profile(fixtures.demo_raw(spark, sf_dir)), 5)


@query
def raw_integrity(spark, sf_dir):
    return checks.integrity(fixtures.demo_raw(spark, sf_dir), {k: m for k, m in fixtures.demo_meta().items() if k != "urgent_orders"})


@query
def raw_structure(spark, sf_dir):
    """Every series held to its frequency, one of them to single vintages as well."""
    metas = {k: replace(m, revision_type="single") if k == "order_count" else m for k, m in fixtures.demo_meta().items()}
    return checks.structure(fixtures.demo_raw(spark, sf_dir), metas)


@query
def event_gaps(spark, sf_dir):
    """Days without an event of a type, over the event stream."""
    daily = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("ref_period"), F.lit(None).cast("date").alias("vintage_date"), "value")
    base = next(iter(fixtures.demo_meta().values()))
    kinds = [r["series"] for r in daily.select("series").distinct().collect()]  # the configuration: a row a type
    out = checks.structure(daily, {k: replace(base, freq="D", revision_type="multi") for k in kinds if k is not None})
    return out.select("series", "n_periods", "missing_periods", "first_missing", "last_missing", "ok")


@query
def event_value_quantiles(spark, sf_dir):
    """Exact quantiles of the values of each type of event."""
    return _rounded(quantiles.exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.0, 0.01, 0.5, 0.99, 1.0]))


# -- results and signals --------------------------------------------------------------------------------


def _results(spark, sf_dir):
    ds = _dataset(spark, sf_dir)
    return signals.nowcast_results(rolling.run_rolling(ds, ROLLING, XS[:1]), XS)


@query
def nowcast_results(spark, sf_dir):
    return _rounded(_results(spark, sf_dir).withColumn("model_name", F.col("meta")["model_name"]).drop("meta"), 5)


@query
def nowcast_signals(spark, sf_dir):
    return _rounded(signals.to_signals(_results(spark, sf_dir)), 5)


@query
def run_daily(spark, sf_dir):
    """One day's nowcast from what was known on that day."""
    return _rounded(nowcaster(spark, sf_dir).run_daily("2000-05-17"), 4)


@query
def run_daily_from_state(spark, sf_dir):
    """The same day's nowcast from a state that got its rows in two files and was moved on from an earlier month's run."""
    n = nowcaster(spark, sf_dir)
    raw = cut(n.raw)
    state = DailyState(replace(n, raw=raw), f"{checkpoint_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}")
    early = F.coalesce("vintage_date", "ref_period") < F.lit("2000-01-15").cast("date")
    state.add(raw.where(early))
    state.run_daily("2000-01-10")
    state.add(raw.where(~early))
    return _rounded(state.run_daily("2000-05-17"), 4)
