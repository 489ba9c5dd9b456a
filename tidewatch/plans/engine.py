"""End-to-end runs: files or tables to panels, datasets, predictions, evaluations and signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import ARConfig, RollingConfig, SeriesMeta
from tidewatch.operators import autoregression, bitemporal, evaluation, rolling, signals
from tidewatch.operators.calendar import build_calendar
from tidewatch.operators.dataset import bridge_dataset, feature_columns
from tidewatch.operators.features import event_features
from tidewatch.operators.panel import apply_missing_policy, by_vintage_mode, daily_panel, expand_days, panel_events
from tidewatch.session import cut
from tidewatch.sources.results import fingerprint, parquet_or_build, write_csv


@dataclass(frozen=True)
class Nowcaster:
    """A configured run over a long raw table."""

    raw: DataFrame
    metas: Mapping[str, SeriesMeta]
    target: str
    start: str
    end: str
    rolling: RollingConfig = field(default_factory=RollingConfig)
    ar: ARConfig = field(default_factory=ARConfig)
    strict: bool = False
    #: Whether each series' configured vintage_mode and missing_policy count; days after a release up to which "skip" keeps a value.
    policies: bool = False
    stale_days: int = 0

    def calendar(self, superseded: bool = False) -> DataFrame:
        """superseded: with releases that are the latest as of an earlier date only."""
        cal = build_calendar(self.raw, self.metas, self.strict)
        return by_vintage_mode(cal, self.metas, superseded).drop("release_number") if self.policies else cal

    def panel(self, as_of: str | None = None) -> DataFrame:
        return self._held(daily_panel(self.calendar(as_of is not None), self.start, self.end, as_of=as_of))

    def _held(self, daily: DataFrame, *more: str) -> DataFrame:
        return apply_missing_policy(daily, self.metas, self.stale_days, ("value", *more)).drop("is_missing") if self.policies else daily

    def daily_features(self, as_of: str | None = None) -> DataFrame:
        """(series, as_of_date, ref_period, value, feature, age_days), as of a date if one is given."""
        events = event_features(panel_events(self.calendar(as_of is not None), self.start, self.end, as_of=as_of), self.metas)
        return self._held(expand_days(events, "feature"), "feature")

    def dataset(self, as_of: str | None = None, **kw) -> DataFrame:
        """The regression rows; with ``as_of`` from no vintage dated later."""
        return bridge_dataset(None, self.metas, self.target, daily=self.daily_features(as_of), **kw)

    def datasets_as_of(self, as_ofs: Sequence[str | date], **kw) -> DataFrame:
        """The datasets of many dates in one plan, told apart by ``as_of``."""
        daily = bitemporal.features_as_of(self.calendar(True), self.metas, as_ofs, self.start, self.end)
        return bridge_dataset(None, self.metas, self.target, daily=self._held(daily, "feature"), by=bitemporal.BY, **kw)

    def real_time_dataset(self, end: str | None = None, **kw) -> DataFrame:
        """The regression rows, each from what was known on its own origin date."""
        daily = bitemporal.knowledge_features(self.calendar(True), self.metas, self.start, min(end or self.end, self.end))
        return bridge_dataset(None, self.metas, self.target, daily=self._held(daily, "feature"), **kw)

    def cached_dataset(self, path: str, rebuild: bool = False) -> DataFrame:
        """The dataset at ``path``, built if there is none yet or the raw rows or settings are others than those it was built from."""
        key = fingerprint(self.raw, sorted(self.metas.items()), self.target, self.start, self.end, self.strict, self.policies, self.stale_days)
        return parquet_or_build(self.raw.sparkSession, path, self.dataset, rebuild, key)

    def targets(self) -> DataFrame:
        return autoregression.quarterly_targets(self.calendar().where(F.col("series") == self.target))

    def bridge_predictions(self, ds: DataFrame | None = None) -> DataFrame:
        return rolling.run_rolling(self.dataset() if ds is None else ds, self.rolling)

    def stage_predictions(self, ds: DataFrame | None = None) -> DataFrame:
        ds = self.dataset() if ds is None else ds
        return rolling.stage_predict(ds, rolling.features_of(ds), self.rolling)

    def ar_predictions(self) -> DataFrame:
        return autoregression.expand_to_daily(autoregression.quarterly_forecasts(self.targets(), self.ar))

    def fit_history(self, as_of: str) -> DataFrame:
        """Nowcast results of all origin dates up to ``as_of``, from what was known then.

        Every refit learns from the dataset as of its own date, and every prediction is made from features as known on
        its origin date. All refits' datasets are one plan.
        """
        origins = cut(self.real_time_dataset(as_of))
        refits = rolling.refit_dates(origins, self.rolling)
        xs = rolling.features_of(origins)
        found = bitemporal.fits_as_of(self.datasets_as_of(refits), xs, self.rolling)
        return signals.nowcast_results(rolling.predict(origins, found, xs, self.rolling), feature_columns(origins))

    def run_daily(self, day: str, cfg: signals.SignalConfig | None = None) -> DataFrame:
        """The day's nowcast with its signal and confidence: one row, or none if there is no model for the day.

        The model is that of the day's refit, as of the refit's date; the features are as known on the day.
        """
        refit = max(date.fromisoformat(self.rolling.test_start), date.fromisoformat(day).replace(day=1))
        both = cut(self.datasets_as_of([refit, day]))
        today = both.where((F.col("as_of") == F.lit(day).cast("date")) & (F.col("origin_date") == F.col("as_of"))).drop("as_of")
        xs = rolling.features_of(today)
        found = bitemporal.fits_as_of(both.where(F.col("as_of") == F.lit(refit)), xs, self.rolling)
        return signals.to_signals(signals.nowcast_results(rolling.predict(today, found, xs, self.rolling), feature_columns(today)), cfg)

    def save(self, out_dir: str) -> dict[str, str]:
        """Predictions, evaluations of all models, their comparison and the clean nowcast as CSV; returns the paths."""
        paths = {}

        def put(name: str, df: DataFrame, path: str, one_file: bool = False) -> None:
            write_csv(df, f"{out_dir}/{path}", one_file)
            paths[name] = f"{out_dir}/{path}"

        ds = self.cached_dataset(f"{out_dir}/dataset.parquet", rebuild=True)
        if ds.where(F.col("origin_date") >= F.lit(self.rolling.test_start).cast("date")).isEmpty():
            raise ValueError(f"no rows on or after {self.rolling.test_start}")
        ar = self.ar_predictions()
        if ar.isEmpty():
            raise ValueError("no quarter to forecast")
        put("ar_daily", ar, "results/ar_daily_predictions.csv")
        paths |= evaluation.evaluate_to_files(ar, f"{out_dir}/eval/outputs/ar")
        for short, preds in (("simple", self.bridge_predictions(ds)), ("stage", self.stage_predictions(ds).drop("refit_date", "stage_model"))):
            preds = preds.persist()  # predictions, slices and the clean output read it
            try:
                if preds.isEmpty():
                    raise RuntimeError("no predictions: see eligible refits, min_train_rows and the dataset's coverage")
                put(f"{short}_predictions", preds, f"results/{short}_bridge_predictions.csv")
                slices = evaluation.slice_metrics(preds)
                for kind in ("overall", "time_slice", "distance_bucket"):
                    put(f"{short}_{kind}", slices.where(F.col("slice_type") == kind).orderBy("slice"), f"eval/bridge_{kind}_{short}.csv", one_file=True)
                if short == "simple":
                    put("nowcast", rolling.clean_nowcast(preds).orderBy("origin_date"), "nowcast/nowcast_daily.csv")
            finally:
                preds.unpersist()
        evaluation.compare_files(self.raw.sparkSession, f"{out_dir}/eval")
        paths["model_compare"] = f"{out_dir}/eval/model_compare.csv"
        return paths
